import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.parity import assert_same, connect
from tidemark.llm import html_blocks, page_differencing, sharding, warc
from tidemark.llm.noisy_channel import Model, restored, trigrams
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.toxicity import clean_texts, toxicity


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def record(k, url, ts, kind, etag=None, modified=None, **headers):
    return (k, url, ts, kind, etag, modified, headers)


@pytest.mark.parametrize("width", [1, 10, 10**6])
def test_revisits(spark, width):
    rows = [
        record(1, "http://A.com/x/?utm_a=1#f", 1, "response", "e1", None, server="s", date="1", **{"content-length": "9"}), record(2, "https://a.com/x", 5, "revisit", "e1", None, date="5", **{"content-length": "0"}),
        record(3, "http://a.com/x", 8, "response", "e2", "m2"), record(4, "http://a.com:80/x", 8, "revisit", "e1"), record(5, "http://a.com/x", 30, "revisit", None, "m2"), record(6, "http://a.com/x", 31, "revisit", None, None),
        record(7, "http://b.com/", 3, "revisit", "e"), record(8, None, 3, "response", "e"), record(9, None, 4, "revisit", "e"), record(10, "http://a.com/x", None, "revisit", "e1"), record(11, "http://a.com/x", 30, "revisit", None, "m3"),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    found = {r.record_id: r for r in warc.resolve_revisits(frame, width).collect()}
    assert {k: r.status for k, r in found.items()} == {1: "response", 2: "resolved", 3: "response", 4: "etag_mismatch", 5: "resolved", 6: "unvalidated", 7: "no_origin", 8: "response", 9: "no_origin", 10: "no_origin", 11: "date_mismatch"}
    assert found[2].origin_id == 1 and found[2].headers == {"server": "s", "date": "5", "content-length": "9"} and found[5].origin_id == 3
    assert warc.resolve_revisits(frame.limit(0), width).count() == 0


def test_shards_are_full_and_slots_gapless(documents, awkward, nothing):
    rows = sharding.shard_documents(documents, shards=4).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert {r.doc_id: r.size for r in rows} == {i: len((t or "").encode()) + 8 for i, t in awkward.items()}
    assert sharding.shard_documents(nothing).count() == 0


def test_a_new_shard_moves_few_keys(spark):
    keys = spark.range(4000).select(F.col("id").alias("k"))
    place = lambda n: {r.k: r.shard for r in sharding.bounded_shards(keys, F.col("k"), [F.col("k")], n).collect()}
    a, b = place(10), place(11)
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)


def test_repeated_and_null_keys_get_slots(spark):
    frame = spark.createDataFrame([(None, "a")] * 5 + [(1, "b")] * 5, "doc_id long, text string")
    rows = sharding.shard_documents(frame, shards=3).collect()
    assert len(rows) == 10 and len({(r.shard, r.slot) for r in rows}) == 10


def test_blocks():
    page = (
        "<html><head><title>x</title></head><body><header><div>Site</div></header><div class='cookie-notice'>We use <p>cookies</div><nav><ul><li>a</ul></nav><p>Hello &amp; <b>wor</b>ld</p>"
        "<div id=comments><div>Nice<div>post</div></div></div><p>Second<br>line &lt;3</p><table><tr><td>a</td><td>b</td></tr></table><script>var a='</p>'</script><form>q</form><p hidden>no</p><footer>foot</foo"
    )
    kept = [b.text for b in html_blocks.blocks(page) if not b.beside]
    assert kept == ["Hello & world", "Second", "line <3", "a b"]
    assert html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("a < b <3 c")] == ["a < b <3 c"]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = page_differencing.common_subsequence(a, b)
        assert len(places) == table[-1][-1] and places == sorted(set(places))
        rest = iter(b)
        assert all(any(y == a[k] for y in rest) for k in places)


def test_template_lines_go(spark):
    page = lambda body: f"<body><div>Menu line</div>{body}<div>Made with care</div></body>"
    rows = [
        (1, "http://h.com/a/1", page("<p>First story</p><p>More</p>")), (2, "http://h.com/a/12", page("<p>Second story</p>")), (3, "http://other.com/a/1", page("<p>Alone</p>")), (4, None, page("<p>No address</p>")),
        (5, "http://h.com/a/2", None), (6, "http://c.com/a/1", page("<p>Copy</p>")), (7, "http://c.com/a/1?x", page("<p>Copy</p>")), (8, "http://h.com/z/9", "<nav>n</nav><article><h1>T</h1><p>Made with care</p></article>"),
    ]
    found = {r.page_id: r.text for r in page_differencing.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Menu line\n{}\nMade with care"
    assert found == {1: "First story\nMore", 2: "Second story", 3: whole.format("Alone"), 4: whole.format("No address"), 5: "", 6: whole.format("Copy"), 7: whole.format("Copy"), 8: "T\nMade with care"}


def test_template_lines_in_articles_go(spark):
    page = lambda *lines: "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    rows = [(k, f"http://h.com/a/p{k}", page(f"Story {k}", f"More {k}", "Share this", *(["Quoted"] if k < 3 else []), f"End {k}")) for k in range(1, 7)]
    rows += [(k, f"http://c.com/a/p{k}", page("Copy", "of", "one")) for k in range(11, 15)] + [(k, f"http://two.com/a/p{k}", page(f"Own {k}", "Quoted")) for k in (21, 22)]
    found = {r.page_id: r.text for r in page_differencing.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    stories = {k: f"Story {k}\nMore {k}\n" + ("Quoted\n" if k < 3 else "") + f"End {k}" for k in range(1, 7)}
    assert found == stories | {k: "Copy\nof\none" for k in range(11, 15)} | {k: f"Own {k}\nQuoted" for k in (21, 22)}


@pytest.mark.parametrize("block", [page_differencing.BLOCK, 2])
def test_neighbours_of_a_whole_host(spark, block, monkeypatch):
    monkeypatch.setattr(page_differencing, "BLOCK", block)
    page = lambda k: "".join(f"<p>Menu {j}</p>" for j in range(20)) + f"<p>Story {k}</p><p>More {k}</p>"
    rows = [(k, f"http://h.com/2024/{k}/slug{'/' * (k % 2)}", page(k)) for k in range(40)] + [(50, "http://c.com/a/", "<p>Copy</p>"), (51, "http://c.com/b/", "<p>Copy</p>")]
    found = {r.page_id: r.text for r in page_differencing.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Story {k}\nMore {k}" for k in range(40)} | {50: "Copy", 51: "Copy"}


def test_disguises_are_restored():
    words = {"idiot": 40, "stupid": 40, "window": 30, "table": 30, "steel": 30, "moral": 20, "nation": 20, "good": 30}
    model = Model(trigrams(" ".join([w] * n) for w, n in words.items()))
    assert [restored(w, model) for w in ("1d10t", "id.i-ot", "stuuuupid", "$tup1d", "w1nd0w", "goooood")] == ["idiot", "idiot", "stupid", "stupid", "window", "good"]


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(9)
    plain = ["river", "stone", "window", "garden", "nation", "market", "silver", "winter", "summer", "letter", "common", "number"]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) + rng.choice(["", "s", "ing", "ed"]) for _ in range(25)]
        bad = k % 6 == 0
        if bad:
            words[rng.randrange(25)] = rng.choice(["scoundrel", "scoundrels"] if k < 480 else ["sc0undr3l", "scoouuuundrel", "s c o u n d r e l"])
        rows.append((k, " ".join(words), "x"))
        if k < 480:
            labels.append((k, int(bad)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "scoundrel here", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_of_disguised_words(toxic):
    documents, labels = toxic
    found = {r.doc_id: r for r in toxicity(documents, labels).collect()}
    wrong = [k for k in range(600) if found[k].predicted != int(k % 6 == 0)]
    assert len(wrong) <= 6 and all(0 <= r.score <= 1 for r in found.values())
    assert found[1000].predicted == found[1001].predicted == 0 and found[None].predicted == 1
    kept = clean_texts(documents, labels)
    assert kept.columns == documents.columns and kept.filter("doc_id = 0").count() == 0 and kept.filter("doc_id = 1").count() == 1


def test_toxicity_without_labels(toxic):
    documents, labels = toxic
    assert toxicity(documents, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity(documents.limit(0), labels).count() == 0


def test_names_inside_articles():
    page = (
        "<article><h2 id='related-work'>Related work</h2><p class='share-price'>Prices rose</p><section id='social-history'><p>History</p></section><p>Let <math><mi>x</mi></math> be</p>"
        "<div class='comments'><p>Nice</p></div><div class='share-buttons'>Share</div><aside>Aside</aside></article>"
    )
    assert [b.text for b in html_blocks.blocks(page) if not b.beside] == ["Related work", "Prices rose", "History", "Let x be"]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<main><h1>T</h1><p>Text</p><article class='comment'><p>first!</p></article><p>More</p></main>", ["T", "Text", "More"]),
        ("<article>Text</article><section id='comments'><article>c1</article><article>c2</article></section><p>End</p>", ["Text", "End"]),
        ("<article><p>Text</p><ul><li>One<li class='share'>Share this</li><li>Two</li></ul><p class='advert'>Buy now</p><p>End</p></article>", ["Text", "One", "Two", "End"]),
        ("<main><article><p>a</p></article><article hidden><p>b</p></article><article role='complementary'>c</article></main>", ["a"]),
        ("<div class='sidebar'><p>Side<article><p>Text</p></article>", ["Text"]),
        ("<main><div class='comments'><article><p>x</p><article>y</article></article><p>z</p></div><p>Text</p></main>", ["Text"]),
    ],
)
def test_comments_and_adverts_of_articles(page, wanted):
    assert [b.text for b in html_blocks.blocks(page) if not b.beside] == wanted


def test_shared_headlines_stay(spark):
    rows = [(k, f"http://a.com/{k}", f"<article><h1>Letters to the editor</h1><p>Own {k}</p><p>Own too {k}</p><p>Subscribe</p></article>") for k in range(4)]
    found = {r.page_id: r.text for r in page_differencing.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Letters to the editor\nOwn {k}\nOwn too {k}" for k in range(4)}


def neighbours_by_brute_force(rows):
    """Text by page: every page of a host against the two before and after it, lines aligned by the quadratic table."""

    def aligned(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        return table[0][0] if a and b else 0

    out, hosts = {}, {}
    for page_id, url, html in rows:
        host, _, path = url.split("//", 1)[1].partition("/")
        hosts.setdefault(host, []).append(("/" + path, page_id, [b.text for b in html_blocks.blocks(html) if not b.beside]))
    for pages in hosts.values():
        pages.sort()
        for k, (_, page_id, lines) in enumerate(pages):
            near = [x[2] for x in pages[max(0, k - 2) : k] + pages[k + 1 : k + 3]]
            telling = [x for x in near if x and aligned(lines, x) < page_differencing.COPY * len(lines)]
            gone = {x for x in lines if len(telling) > 1 and all(x in other for other in telling)}
            out[page_id] = "\n".join(x for x in lines if x not in gone)
    return out


@pytest.mark.parametrize("block", [page_differencing.BLOCK, 3])
def test_differencing_matches_brute_force(spark, block, monkeypatch):
    """Articles of distinct lines, some shared by a whole site, some quoted by one other page, some copies of pages."""
    monkeypatch.setattr(page_differencing, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for k in range(60):
        host = f"h{k % 3}.com"
        lines = [f"Own {k} {j}" for j in range(rng.randint(1, 6))] if k % 10 or k < 3 else [f"Own {k - 3} {j}" for j in range(4)]
        lines = ["Subscribe now"] * (k % 3 != 2) + lines + [f"Quote {rng.randrange(4)}"] * (k % 4 == 0) + [f"All rights reserved by {host}"]
        rows.append((k, f"http://{host}/{rng.choice('abc')}/{rng.randrange(100)}", "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"))
    expected = neighbours_by_brute_force(rows)
    found = {r.page_id: r.text for r in page_differencing.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == expected and any("Subscribe" not in x for x in found.values())


def test_pages_empty_and_clashing(spark):
    schema = "page_id long, url string, html string, host string, path string, block int, lines string, before string"
    assert page_differencing.main_texts(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://h/a", "<p>x</p>", "q", "q", 1, "q", "q")] * 2
    assert [r.text for r in page_differencing.main_texts(spark.createDataFrame(rows, schema)).collect()] == ["x", "x"]


def ring_by_brute_force(ids, shards, virtual_nodes):
    """Every key walks the ring clockwise by itself, in the order of cells."""
    nodes, room = sharding.ring(shards, virtual_nodes), sharding.capacities(len(ids), shards)
    counts = {}
    for cell in sorted(ids):
        begin = next((k for k, (at, _) in enumerate(nodes) if at >= cell), 0)
        shard = next(s for _, s in nodes[begin:] + nodes[:begin] if room[s])
        room[shard] -= 1
        counts[cell, shard] = counts.get((cell, shard), 0) + 1
    return counts


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_ring_matches_brute_force(spark, shards):
    keys = spark.range(700).select(F.col("id").alias("k"))
    cell = F.shiftrightunsigned(F.xxhash64("k"), 48).cast("int")
    cells = {r.k: r.cell for r in keys.select("k", cell.alias("cell")).collect()}
    found = {}
    for r in sharding.bounded_shards(keys, F.col("k"), [F.col("k")], shards).collect():
        found[cells[r.k], r.shard] = found.get((cells[r.k], r.shard), 0) + 1
    assert found == ring_by_brute_force(list(cells.values()), shards, 64)


def test_movement_on_growth(spark):
    """24 to 25 shards move little more than the 4 % that the new one takes."""
    keys = spark.range(40_000).select(F.col("id").alias("k"))
    place = lambda n: {r.k: r.shard for r in sharding.bounded_shards(keys, F.col("k"), [F.col("k")], n).collect()}
    a, b = place(24), place(25)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert 0.04 <= moved <= 0.15


def test_decoder_matches_all_paths():
    """Viterbi against every path through small lattices."""
    from tidemark.llm import noisy_channel as nc

    model = Model(trigrams(["idiot stupid window table steel moral nation good a so is it", "the idea is good so it is a window"]))

    def value(path):
        total, state = 0.0, "  "
        for text, channel in path:
            total += channel
            if text == nc.BREAK:
                if state == "  ":
                    return None
                total, state = total + model.log(state + " "), "  "
            for c in text if text != nc.BREAK else "":
                c = nc.letter(c)
                total, state = total + model.log(state + c), state[1] + c
        return total if state == "  " else total + model.log(state + " ")

    for lattice in (nc.choices("1d10t"), nc.choices("st.u00p"), nc.spaced_choices(["i", "5", "a"], [nc.USUAL, nc.UNUSUAL]), nc.spaced_choices(["ta", "ble"], [nc.SPLIT]), nc.choices("goood!")):
        values = {}
        for path in itertools.product(*lattice):
            v = value(path)
            if v is not None:
                text = "".join(t for t, _ in path)
                values[text] = max(values.get(text, v), v)
        best = nc.decoded(lattice, model)
        assert values[best] == pytest.approx(max(values.values()), abs=1e-9)


def test_spacing_is_decoded():
    from tidemark.llm import noisy_channel as nc

    model = Model(trigrams(["you are a stupid idiot and a good nation so is it", "an idiot is a stupid man a idiot a window"] * 20))
    assert nc.spelt_out("x\ns t u p i d\n i d i o t", model) == ["stupid", "idiot"]
    for gap in (" " * 4, " " * 40, "\n" * 4, " \t\r\n"):
        assert nc.spelt_out(f"you {gap.join('idiot')} there", model) == ["idiot"], repr(gap)
    assert nc.spelt_out("you  i  d  i  o  t", model) == ["idiot"] and nc.spelt_out("i\td\ti\to\tt", model) == ["idiot"] and nc.spelt_out("s-t-u-p-i-d", model) == ["stupid"]
    assert nc.joins("id", "iot", model) and not nc.joins("good", "nation", model)
    assert nc.restored("i" * 300 + "di" + "o" * 200 + "t", model) == "idiot"


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_toxicity(spark, sf_dir, sf):
    """Recall and precision on labelled rows that weren't learned from."""
    folder = sf_dir.replace("sf0.001", sf)
    rows = QUERIES["op5_noisy_channel"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out AND toxic IN (0, 1)")
    counts = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert hit >= 0.9 * (hit + missed) and hit >= 0.95 * (hit + wrong)


def test_clashing_columns_of_stages(toxic):
    documents, labels = toxic
    clashing = documents.withColumns({"_score": F.lit(1), "__score": F.lit(2), "_text": F.lit("x"), "SCORE2": F.lit(3)})
    kept = clean_texts(clashing, labels)
    assert kept.columns == clashing.columns and kept.filter("doc_id = 1").count() == 1
    repeated = documents.filter("doc_id < 30").union(documents.filter("doc_id < 30"))
    scores = toxicity(repeated, labels).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("k"))
    assert scores.filter("n <> 2 OR k <> 1").count() == 0
