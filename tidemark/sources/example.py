"""A small example of the fourteen raw tables: three companies, one that raises twice, is acquired and has a founding chief executive; one without rounds; one too old."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import write_csv

EMPTY = {
    "PersonBoardSeatRelation": "PersonID CompanyID StartDate IsCurrent", "PersonAdvisoryRelation": "PersonID EntityID StartDate IsCurrent",
    "PersonAffiliatedDealRelation": "PersonID CompanyID DealDate", "PersonAffiliatedFundRelation": "PersonID FundID InvestorID", "Fund": "FundID Vintage",
}
COMPANY = "CompanyID YearFounded HQCountry PrimaryIndustrySector OwnershipStatus OwnershipStatusDate CompanyFinancingStatusDate BusinessStatusDate FirstFinancingDate LastKnownValuationDate FiscalPeriod"
TABLES = {
    "Company": (COMPANY, [
        ("a", "2005", "Italy", "IT", "Acquired/Merged", "03/03/2012", "NA", None, "01/01/2007", None, None), ("b", "2010", "Spain", "Health", "Privately Held (backing)", "01/01/2012", None, None, None, None, "TTM 2Q2013"),
        ("z", "1990", "Italy", "IT", None, None, None, None, "01/01/2015", None, None),
    ]),
    "Person": ("PersonID Gender", [("p", "Female"), ("q", None)]),
    "CompanyBoardTeamRelation": ("CompanyID PersonID PersonName FullTitle IsCurrent StartDate EndDate LastUpdated", [
        ("a", "p", "Ann Ph.D", "Founder & CEO", "Yes", "01/01/2005", None, None), ("a", "q", "Quin", "Advisor", None, "06/01/2008", "06/01/2009", None), ("b", "q", "Quin", "Director", None, None, None, None),
    ]),
    "PersonEducationRelation": ("PersonID Degree Major_Concentration GraduatingYear", [("q", "BSc", "biology", "2008")]),
    "PersonPositionRelation": ("PersonID EntityID StartDate PositionLevel IsCurrent", [("p", "a", "01/01/2005", "Executive", "Yes"), ("q", "x", None, None, None)]),
    "Deal": ("CompanyID DealID DealNo DealDate DealType TotalInvestedCapital CEOPBId DealSize", [
        ("a", "1", "1", None, "Seed Round", None, "p", "1"), ("a", "2", "2", "05/05/2009", "Early Stage VC", "2.5", "p", "2.5"), ("a", "3", "3", None, "Merger/Acquisition", "9", None, "9"),
    ]),
    "DealInvestorRelation": ("DealID InvestorID InvestorStatus IsLeadInvestor", [("2", "i", "New Investor", "Yes"), ("2", "j", None, None)]),
    "Investor": ("InvestorID PrimaryInvestorType TotalInvestments MedianRoundAmount YearFounded", [("i", "Corporation", "40", "7", "1999"), ("j", "Angel Group", "2", "1", None)]),
    "CompanySimilarRelation": ("CompanyID SimilarCompanyID SimilarityScore IsCompetitor SimilarCompanyHQCountry", [("a", "z", "80", "Yes", "Italy"), ("a", "b", "40", "No", "Spain"), ("b", "out", "50", "Yes", None)]),
} | {name: (columns, []) for name, columns in EMPTY.items()}


def frames_of(spark: SparkSession, tables: Mapping[str, tuple[str, Sequence[tuple]]] = TABLES) -> dict[str, DataFrame]:
    """Frames of texts from column names and rows by table; a row of another width than its columns is an error."""
    for name, (columns, rows) in tables.items():
        for row in rows:
            if len(row) != len(columns.split()):
                raise ValueError(f"{name}: a row has {len(row)} values instead of {len(columns.split())}")
    return {name: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split())) for name, (columns, rows) in tables.items()}


def write_tables(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as `<folder>/<name>.csv`, where the panel's sources look for it."""
    for name, df in frames.items():
        write_csv(df.coalesce(1) if df.isEmpty() else df, f"{folder}/{name}.csv")
