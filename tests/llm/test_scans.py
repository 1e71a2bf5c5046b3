import random

import numpy as np
from pyspark.sql import functions as F

from strandweave.llm import scans as S

NOUNS = ["register", "harvest", "tribunal", "surcharge", "contract", "applicant", "district", "reservoir", "orchard", "wetland", "committee", "secretary"]


def clean(rng):
    said = lambda: f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} shall not amend the {rng.choice(NOUNS)} under section {rng.randint(1, 90)} of the {rng.choice(NOUNS)}."
    return " ".join(said() for _ in range(4))


def corpus(spark):
    rng = random.Random(4)
    rows = [("e", f"c{i}", clean(rng)) for i in range(300)]
    rows += [
        ("e", "break", "The register of the harvest shall\nnot amend the tri-\nbunal under section 4 of the contract."),
        ("e", "misread", "The register of the harvest shall not amend the tribiinal under secti0n 4 of the 0rchard."),
        ("e", "page", clean(rng) + "\n\n- 7 -\n\n" + clean(rng)),
        ("e", "list", "## Section 4\n\n- The register\n- The harvest\n\n| no. | item |\n| 1 | harvest |"),
        ("e", "null", None), ("e", "empty", ""), ("e", "name", clean(rng) + " The plan of Zoletopa is on page 32 of annex 8, form O9-B9."),
    ]
    return spark.createDataFrame(rows, "tab string, id string, t string")


def test_marks_and_repairs(spark):
    none = spark.createDataFrame([], "id string, headers array<string>")
    got = {r.id: r for r in S.restore(corpus(spark).filter("id = 'page'"), corpus(spark).filter("id <> 'page'"), "tab", "id", "t", none, "id").collect()}
    marked = {k for k, r in got.items() if r.marks}
    assert marked == {"break", "misread", "page"}
    assert got["break"].restored == "The register of the harvest shall not amend the tribunal under section 4 of the contract."
    assert "tribunal" in got["misread"].restored and "orchard" in got["misread"].restored
    assert "- 7 -" not in got["page"].restored and got["null"].restored is None and got["empty"].restored == ""


def test_headers_come_back_within_a_file(spark):
    pages = [(f"p{i}", "f1", f"THE OPEN LEDGER L0VAPIDU\n\nBody number {i} is here and goes on." if i % 2 else f"The open ledger Lovapidu\nBody {i} of another page is here.") for i in range(4)]
    pages += [("q1", "f2", "Only once on a page\n\nBody."), ("q2", None, "The open ledger Lovapidu\nBody."), ("q3", "f2", None)]
    df = spark.createDataFrame(pages, "page_id string, file_id string, markdown string").withColumn("line", F.lit(1)).drop("line")
    got = {r.page_id: r.headers for r in S.file_headers(df, "page_id", "file_id", "markdown").collect()}
    assert set(got) == {"p0", "p1", "p2", "p3"}
    assert S.file_headers(df.limit(0), "page_id", "file_id", "markdown").count() == 0


def test_long_rare_stretches_are_decoded():
    rng = random.Random(4)
    four, five = S._cells(S._codes(S.flat(" ".join(clean(rng) for _ in range(300)))))
    source = S.Source(np.bincount(np.concatenate([four, five]), minlength=S.CELLS).astype(np.float32))
    for read, true in (("thc rcgistcr of", "the register of"), ("thc rcgistcr of thc rcscrvoir shall not amcnd thc district", "the register of the reservoir shall not amend the district")):
        line = f"    {read}    "
        places = source.rare_places([line])[0]
        assert len(places) > 7
        for a, b, original in reversed(source.misread(line, places)):
            line = line[:a] + original + line[b:]
        assert line.strip() == true
