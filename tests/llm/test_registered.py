"""The registered queries of the subpackage over the smallest tables: with their SQL, the libraries or plain versions."""

import hashlib
import os
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from verbamill.llm import bpe, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda found: sorted(map(str, found))
    columns = sorted(df.columns)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_token_counts(spark, texts):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op1_token_counts(spark, SF).collect()}
    n = {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(t.encode()), n[i], n[i] > 512) for i, t in texts.items()}


def test_byte_bpe(spark, texts):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in queries.op3_byte_bpe(spark, SF).collect():
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r["doc_id"]].encode()))


def test_secrets(spark, texts):
    found = queries.op8_secret_scan(spark, SF).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        t = texts[r["doc_id"]]
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def crc(n):
    import zlib

    return zlib.crc32(str(n).encode())


@pytest.mark.parametrize("name, label, of, out", [("op4_quality_classifier", "quality", 3, 1), ("op7_toxicity", "toxic", 5, 0)])
def test_classifiers(spark, duck, texts, name, label, of, out):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(r["held_out"] == (crc(r["doc_id"]) % of == out) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = dict(duck.sql(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall())
    held = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean(held) >= 0.85


def test_packing(spark, texts):
    import zlib
    from collections import defaultdict

    whole, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), defaultdict(int)
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    total = 0
    for r in queries.op9_packing(spark, SF).orderBy("doc_id", "start").collect():
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
        total = max(total, r["sequence_id"] + 1)
    assert dict(at) == {i: len(x) for i, x in ids.items()} and total <= -(-sum(map(len, ids.values())) // 4096) * 1.02 + 1
