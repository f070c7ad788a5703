"""Keys that stand in one candidate with a base span are found as well."""

from airledger.llm import secret_scan

KEY = "wJalrXUtnF3MIeK7MDbENGbPxRfiCYzQ8mp4Lk2v"


def test_key_beside_base_spans(spark):
    scanner = secret_scan.Scanner()
    access, hexa = "AKIA" + "Q7Z2" * 4, "0123456789abcdef01234567"
    texts = [f"x {access}/{KEY} y", f"x {hexa}_{KEY} y", f"x {KEY}/{access}/{KEY[::-1]} y"]
    for text in texts:
        found = [(s, e) for s, k, e in scanner.spans(text) if k == "entropy"]
        base = [(s, e) for s, k, e in scanner.spans(text) if k != "entropy"]
        assert len(found) == text.count(KEY) + text.count(KEY[::-1]) and all(e <= a or s >= b for s, e in found for a, b in base)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not [r for r in secret_scan.redact(docs).collect() if KEY[4:-4] in r.text or KEY[::-1][4:-4] in r.text]
    assert not [x for x in scanner.spans(f"x {access}/some/path/of/plain/words/only y") if x[1] == "entropy"]
