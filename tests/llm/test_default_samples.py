"""Secrets and license notices that the defaults of the operators must find."""

import random
import textwrap
import uuid

from pointmill.llm import licenses, queries, secrets


def test_default_samples_find_keys_and_leave_identifiers(spark, tmp_path):
    """op10 and redact as registered: planted keys of every alphabet are found, ordinary long tokens stay."""
    rng = random.Random(99)
    keys = [secrets.random_string(kind, n, rng) for kind in ("base62", "base64", "base64url", "base32", "HEX", "base36") for n in (20, 32, 40) for _ in range(20)]
    keys += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=32)) for _ in range(20)]  # without a digit
    clean = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(40)]
    clean += ["0123-4567-8901-2345-6789", "2031-04-05T06-07-08-backup", "invoice_2024_customer_report_v2", "my-long-branch-name-for-fix-1234", "MAX_NUMBER_OF_OPEN_FILES_2"]
    clean += ["AbstractSingletonProxyFactoryBean", "src/main/java/org/example/app", "thisisanordinarylongidentifier", "------------------------------"]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + clean)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"] for r in queries.op10_secrets(spark, str(tmp_path)).filter("spans <> ''").collect()}
    assert len(found & set(range(len(keys)))) >= 0.98 * len(keys)
    assert not [t for i, t in enumerate(keys + clean) if i in found and i >= len(keys)]
    left = {r["doc_id"] for r in secrets.redact(docs).filter("NOT contains(text, '[SECRET]')").collect()}
    assert left == set(range(len(keys) + len(clean))) - found


def test_wrapped_notices(spark, tmp_path):
    """Every template hard-wrapped at any width, with comment marks and text around, is found as on one line; against all windows by brute force."""
    rng, texts = random.Random(7), []
    for _, t in licenses.TEMPLATES:
        for width, mark in ((12, ""), (24, "# "), (40, " * "), (72, "// "), (500, "")):
            around = [" ".join(rng.choices(["alpha", "beta", "the", "and", "is", "to", "of", "use"], k=rng.randrange(30))) for _ in range(2)]
            texts.append(around[0] + "\n" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + "\n" + around[1])
    texts += ["Permission is hereby granted, free of\n" + "other words here " * 60 + "\ncharge, to any person obtaining a copy of this software and associated"]
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.split()]
    texts += ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 6))) for _ in range(40)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in queries.op5_license_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        own = licenses.words(text)
        want = {label for phrase, label in licenses.PHRASES if licenses.places(own, licenses.words(phrase))}
        for label, t in licenses.TEMPLATES:
            distinct, n = set(licenses.words(t)), -(-len(licenses.words(t)) * 5 // 4)
            blocks = [licenses.words(line) for line in text.split("\n")] + [own[j : j + n] for j in range(len(own))]
            if any(len(distinct & set(b)) >= 0.8 * len(distinct) - 1e-9 for b in blocks):
                want.add(label)
        assert got[i] == want
    for i in range(5 * len(licenses.TEMPLATES)):
        assert licenses.TEMPLATES[i // 5][0] in got[i]
    assert "mit" not in got[5 * len(licenses.TEMPLATES)]
