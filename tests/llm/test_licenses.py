"""Whole licence files against the table of known texts."""

from pathlib import Path

from trustframe.llm import licenses

FILES = sorted(Path(__file__).with_name("license_files").glob("*.txt"))


def test_real_license_files(spark):
    rows = [(f"{p.stem.split('__')[0]}|{p.name}", p.read_text(encoding="utf-8")) for p in FILES]
    rows += [(f"{p.stem}|whole", p.read_text(encoding="utf-8")) for p in sorted(licenses.TEXTS.glob("*.txt"))]
    rows += [("None|part", rows[0][1][: len(rows[0][1]) // 2]), ("None|inside", f"A story.\n{rows[0][1]}")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: k.split("|")[0] for k, _ in rows}


def test_one_license_per_digest(spark):
    known = spark.createDataFrame(list(licenses.KNOWN), "license_id string, text string")
    pairs = known.select("license_id", licenses.digest(known["text"]).alias("digest")).distinct()
    assert pairs.count() == licenses.known_digests(spark).count()
