"""Records and dictionaries for tests of whole runs."""

from quillmesh.operators import enrichment as N
from quillmesh.operators import tagging as T

DICTIONARIES = N.Dictionaries(companies=[T.Entity("Acme", "ACM", "Energy", ["acme"])], sectors={"Energy": ["oil"], "Banks": ["bank"]}, topics=[N.Topic("rates", ["rate"])], risks=[T.RiskRule("credit risk", 5, ["default"], ["late", "unpaid"], 2)], lexicon={"positive": ["gain"], "negative": ["loss"], "uncertainty": ["may"]}, signals={"bull": ["gain"], "bear": ["loss"]}, sources={"s1": 0.8})


def raw_records(spark):
    rows = []
    for day in range(1, 9):
        for k in range(3):
            title = f"Acme oil story {day} of gain" if k < 2 else f"Bank number {day * 7} may default with a loss"
            rows.append((f"{day}-{k}", title + (" again" if k == 1 else ""), "", f"http://x/{day}/{k}", f"s{k}", f"2024-01-{day:02d}T0{k}:00:00Z", f"2024-01-{day:02d}T09:00:00Z"))
    return spark.createDataFrame(rows, "article_id string, title string, summary string, url string, source string, published_at string, collected_at string")
