"""Operators 11 and 12 against the sentencepiece library and plain string cuts, and on nulls, long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pointmill.llm import infill, pieces
from pointmill.llm.pieces import MODEL, PieceModel
from pointmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hold(model, library, texts):
    flat, stops = model.encode(texts)
    starts = np.append(0, stops)[:-1]
    want = library.encode(texts, num_threads=1)
    assert [flat[a:b].tolist() for a, b in zip(starts, stops)] == want
    assert model.decode(flat, starts).to_pylist() == library.decode(want)


def test_random_texts_equal_the_library(model, library):
    rng = random.Random(11)
    letters = "ab the▁  \n\t=-<>/é中文😀́\x00.,12 "
    hold(model, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)])
    some = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    hold(model, library, ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))).replace("▁", rng.choice(["", "▁", " "])) for _ in range(4000)])
    for alphabet in ("etaoinshrdlu", "the ", "ab"):
        hold(model, library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)])


def test_runs_and_long_words_equal_the_library(model, library):
    assert model.run == 16
    hold(model, library, [x + " " * k + y for k in range(70) for x in ("", "a") for y in ("", "a", "\n", "the", "=")])
    hold(model, library, [c * k for c in "=-_*a#.\n\t>1" for k in (1, 2, 3, 17, 64, 199)])
    rng = random.Random(12)
    hold(model, library, ["the" * 5000, "=" * 50_000, " " * 50_000, "".join(rng.choice("etaoinshrdlu") for _ in range(50_000)), "".join(rng.choice("abcABC019+/xyzXYZ") for _ in range(100_000))])


def test_rounds_and_queue_agree(model):
    rng = random.Random(13)
    symbols = model.symbol[np.array([ord(rng.choice("etaoinsh")) for _ in range(3000)])]
    starts = np.sort(np.array([0, *rng.sample(range(1, 3000), 40)]))
    a, b = model.merge(symbols.copy(), starts, rounds=0), model.merge(symbols.copy(), starts, rounds=10**6)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(14)
    lists = [[rng.choice([rng.randrange(1, 32_000), rng.randrange(3, 259)]) for _ in range(rng.randint(1, 12))] for _ in range(3000)]
    lists = [[i for i in x if i not in (1, 2)] or [5] for x in lists] + [[259 + k] for k in range(50)]
    flat, sizes = np.concatenate([np.array(x, np.int32) for x in lists]), np.array([len(x) for x in lists])
    assert model.decode(flat, np.cumsum(sizes) - sizes).to_pylist() == [library.decode(x) for x in lists]
    with pytest.raises(ValueError):
        model.decode(np.array([40_000]), np.array([0]))


@pytest.fixture(scope="module")
def odd(spark):
    long = "".join(random.Random(15).choice("word é中\n ") for _ in range(400_000))
    rows = [(1, None), (2, ""), (3, "  "), (4, long), (4, long), (5, "same"), (5, "other 😀"), (6, "a<M>b"), (7, "<S"), (8, "x>P<"), (None, "no id"), *((k, f"text {k} <é> 中") for k in range(20, 140))]
    return spark.createDataFrame([(i, t, "k", k, "x", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key string, n int, form string, ids int")


def test_pieces_of_odd_rows(odd, library):
    got = pieces.decode_pieces(pieces.encode_pieces(odd)).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["decoded"]) for r in got) == want
    assert all(r["ids"] == library.encode(r["decoded"]) for r in got)
    assert pieces.decode_pieces(pieces.encode_pieces(odd.limit(0))).count() == 0


def test_decode_keeps_other_columns(spark):
    df = spark.createDataFrame([(None, 1, "a"), ([], 2, "b"), ([1, 15043, 2], 3, "c")], "ids array<int>, decoded int, ids_of_rows string")
    got = pieces.decode_pieces(df).collect()
    assert [(r["ids_of_rows"], r["decoded"]) for r in got] == [("a", None), ("b", ""), ("c", "discovery")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_piece_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    assert sorted(map(tuple, QUERIES["op11_sentencepiece"](spark, SF).collect())) == sorted(want)


def by_hand(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_cuts_by_hand(odd):
    got = infill.restore(infill.fill_in_middle(odd)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    want = [(r["doc_id"], *by_hand(r["doc_id"], r["text"]), r["text"] or "") for r in odd.collect()]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.restore(infill.fill_in_middle(odd.limit(0))).count() == 0


def test_infill_rates_and_restore_of_given_outputs(spark, odd):
    assert {r["form"] for r in infill.fill_in_middle(odd.filter("doc_id >= 20"), rate=100, spm_rate=100).collect()} == {"spm"}
    assert {r["form"] for r in infill.fill_in_middle(odd, rate=0).collect()} == {"plain"}
    df = spark.createDataFrame([(None, "psm", 1), ("<P>a<S>c<M>b", "psm", 2), ("<S>c<P><M>", "spm", 3), ("x<P>", "plain", 4), ("", None, 5)], "output string, form string, form_of_rows int")
    assert [(r["form_of_rows"], r["restored"]) for r in infill.restore(df).collect()] == [(1, None), (2, "abc"), (3, "c"), (4, "x<P>"), (5, "")]
    with pytest.raises(Exception, match="each mark once"):
        infill.restore(df.filter("form = 'plain'").withColumn("form", F.lit("psm"))).collect()


def test_infill_of_random_bytes_by_displacement():
    rng = random.Random(16)
    texts = ["".join(rng.choice("aé中😀<>PSM") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts = [t for t in texts if not any(m in t for m in ("<P>", "<S>", "<M>"))]
    form = np.array([rng.randrange(3) if t else 0 for t in texts])
    low = np.array([rng.randint(0, len(t)) for t in texts])
    high = np.array([rng.randint(a, len(t)) for a, t in zip(low, texts)])
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    out, outer, _ = infill.scatter(data, bounds, low, high, form)
    for i, t in enumerate(texts):
        p, m, s = t[: low[i]], t[low[i] : high[i]], t[high[i] :]
        want = (t, f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}")[form[i]]
        assert out[outer[i] : outer[i + 1]].tobytes().decode() == want
    back, inner = infill.gather(out, outer, form)
    assert back.tobytes() == b"".join(raw) and (inner == bounds).all()
