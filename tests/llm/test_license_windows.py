import pytest

from weftline.llm import license_scan

MIT = "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files (the Software)"
APACHE = "you may not use this file except in compliance\n * with the License. You may obtain a copy\n * of the License at"


def test_wrapped_and_scattered_notices(spark):
    grant = license_scan.TEMPLATES[1][0]
    scattered = " filler words here ".join(grant.split())
    turned = " ".join(["x", *reversed(grant.split())])
    texts = [MIT, "intro\n" + APACHE + "\noutro", scattered, "Released under\nthe MIT\nLicense.", grant + " " + grant, "y " * 300 + MIT + " z" * 300, grant.replace("hereby ", ""), turned]
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    found = [[(m["label"], r["text"].encode()[m["first_byte"] : m["end_byte"]].decode(), round(m["containment"], 2)) for m in r["matches"]] for r in rows]
    want = MIT.removesuffix(" (the Software)")
    assert found[0] == found[5] == [("mit", want, 1.0)] and found[1] == [("apache-2", APACHE, 1.0)]
    assert found[2] == [] and found[3] == [("mit", "Released under\nthe MIT\nLicense", 1.0)]
    assert found[4] == [("mit", grant, 1.0)] * 2 and found[6] == [("mit", texts[6], 0.95)] and [m[0] for m in found[7]] == ["mit"]


def test_templates_are_bounded(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="at most"):
        license_scan.scan_licenses(docs, templates=(("w " * (license_scan.MAX_WORDS + 1), "big"),))
    assert license_scan.scan_licenses(docs, templates=(), phrases=()).first()["matches"] == []
