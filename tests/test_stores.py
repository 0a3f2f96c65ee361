import pytest
from pyspark.sql import functions as F

from tidemark.plans.experiments import grouped_variants, kept_split
from tidemark.sources import stores


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, k % 3, f"t{k}") for k in range(20)], "id long, part int, text string")


def test_content_is_found_again(spark, rows, tmp_path):
    built = []

    def kept(df, seed=1, tag="a", force=False, **parameters):
        def build():
            built.append((seed, tag))
            return {"even": df.filter("id % 2 = 0"), "odd": df.filter("id % 2 = 1")}, {"names": ["x", "y"]}

        return stores.kept_frames(spark, str(tmp_path), tag, seed, df, parameters, build, force)

    frames, notes = kept(rows)
    assert frames["odd"].count() == 10 and notes == {"names": ["x", "y"]} and len(built) == 1
    kept(rows.orderBy(F.desc("id")).repartition(3))  # the same rows in another order
    assert len(built) == 1
    for change in (lambda: kept(rows.withColumn("part", F.lit(0))), lambda: kept(rows.withColumnRenamed("part", "share")), lambda: kept(rows, seed=2), lambda: kept(rows, tag="ab"), lambda: kept(rows, least=2), lambda: kept(rows, force=True)):
        before = len(built)
        change()
        assert len(built) == before + 1
    assert stores.clear_kept(spark, str(tmp_path), "a") == 5 and stores.clear_kept(spark, str(tmp_path)) == 1
    kept(rows)
    assert stores.clear_kept(spark, str(tmp_path)) == 1


def test_a_broken_write_is_not_found(spark, rows, tmp_path):
    def broken():
        return {"good": rows, "bad": rows.withColumn("x", F.raise_error(F.lit("no")))}, {}

    with pytest.raises(Exception, match="no"):
        stores.kept_frames(spark, str(tmp_path), "a", 1, rows, {}, broken)
    folder = stores.Folder(spark, str(tmp_path))
    assert folder.names() == [] and len(list(tmp_path.iterdir())) == 1
    frames, _ = stores.kept_frames(spark, str(tmp_path), "a", 1, rows, {}, lambda: ({"good": rows}, {}))
    assert frames["good"].count() == 20
    with pytest.raises(Exception, match="no"):  # what was there before stays
        stores.kept_frames(spark, str(tmp_path), "a", 1, rows, {}, broken, force=True)
    assert folder.read(folder.names()[0])[0]["good"].count() == 20
    assert stores.clear_kept(spark, str(tmp_path)) == 1 and not list(tmp_path.iterdir())


def test_results_are_merged(spark, rows, tmp_path):
    path = str(tmp_path)
    assert stores.load_results(spark, path) == {}
    stores.save_results(spark, path, "first", metrics=rows.limit(3), values=rows)
    stores.save_results(spark, path, "second", metrics=rows.limit(2).withColumn("more", F.lit(1)))
    stores.save_results(spark, path, "first", metrics=rows.limit(4), values=rows)
    found = stores.load_results(spark, path)
    assert {r.tag: r["count"] for r in found["metrics"].groupBy("tag").count().collect()} == {"first": 4, "second": 2}
    assert found["values"].count() == 20 and found["metrics"].filter("more IS NULL").count() == 4


def test_splits_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 2, float(k % 7), None if k % 5 == 0 else float(k)) for k in range(60)], "CompanyID long, target int, x double, y double")
    one = kept_split(df, [], ["x", "y"], 1, str(tmp_path), "controlled")
    again = kept_split(df, [], ["x", "y"], 1, str(tmp_path), "controlled")
    assert one.features == again.features == ["x", "y"] and len(list(tmp_path.iterdir())) == 1
    assert sorted(map(tuple, one.test.collect())) == sorted(map(tuple, again.test.collect())) and one.train.count() == 36


def test_grouped_variants():
    made = grouped_variants(["controlled", "leakboth"], {"country": "HQCountry", "sector": "PrimaryIndustrySector"})
    assert len(made) == 12 and made["controlled_scale-country"] == {"setting": "controlled", "impute_by": None, "group": "HQCountry", "families": ["lr", "svm", "mlp"]}
    assert made["leakboth_both-sector"]["impute_by"] == made["leakboth_both-sector"]["group"] == "PrimaryIndustrySector" and "rf" in made["leakboth_both-sector"]["families"]
    with pytest.raises(ValueError, match="unknown"):
        grouped_variants(["controlled"], {}, ["encode"])
