"""The registered queries against SQL, plain versions and libraries, on the smallest tables."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
from check import compare, oracle_connection
from docloom.llm import queries
from docloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf, name):
    verdict, rows, _ = compare(spark, con, sf, name)
    assert verdict == "ok", verdict
    assert rows


def test_all_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())


def test_byte_bpe_matches_tiktoken(spark, sf):
    with open(queries.BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = QUERIES["op8_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_nearest_vectors_reach_most_of_brute_force(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in QUERIES["op9_nearest_vectors"](spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found) == sorted(asked)
    hits = 0
    for q in asked:
        scores = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        best = {int(ids[i]) for i in order}
        hits += len(best & {v for v, _ in found[q]})
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0])) and len(found[q]) == 20
        for v, s in found[q]:
            assert s == pytest.approx(float(scores[ids == v][0]), abs=1e-12)
    assert hits >= 0.9 * 20 * len(asked)


def test_main_text_is_the_article(spark, sf):
    import html
    import re

    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall())
    rows = QUERIES["op3_html_main_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1|article)>", article)
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", b).replace("<b>", ""))).strip() for b in blocks]
        assert r.text == "\n".join(b for b in plain if b)
        assert r.n_chars == len(r.text)


def test_toxicity_tells_held_out_documents_apart(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, d).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{d}/labels.parquet'").fetchall()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{d}/documents.parquet'").fetchall()[0][0]
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(rows[i].score, t) for i, t in labels if rows[i].held_out]
    toxic, ordinary = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in ordinary])
    assert auc > 0.7
    assert np.mean([s >= 0.5 for s in ordinary]) < 0.05


def test_language_of_pages(spark, sf):
    pages = dict(duckdb.sql(f"SELECT page_id, regexp_extract(html, 'lang=\"(..)\"', 1) FROM '{sf}/pages.parquet'").fetchall())
    rows = QUERIES["op6_language_id"](spark, sf).collect()
    assert len(rows) == len(pages)
    assert np.mean([r.lang == pages[r.page_id] for r in rows]) > 0.97


def test_token_counts_match_a_library(spark, sf):
    import sentencepiece
    from tokenizers import Tokenizer, models

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    vocab = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]
    normal = {i for i in range(len(vocab)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    # What is no normal piece must not be matched in a text: a name no text has.
    named = [(p if i in normal or model.is_byte(i) else f"\x00{i}\x00", s if i in normal else min(s for _, s in vocab) - 1e6) for i, (p, s) in enumerate(vocab)]
    lowest = min(vocab[i][1] for i in normal)
    named = [(p, s if i in normal else lowest) for i, (p, s) in enumerate(named)]
    library = Tokenizer(models.Unigram(named, unk_id=0, byte_fallback=True))
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    for r in QUERIES["op7_token_counts"](spark, sf).collect():
        marked = ("▁" + texts[r.doc_id].replace(" ", "▁")) if texts[r.doc_id] else ""
        assert r.n_tokens == len(library.encode(marked, add_special_tokens=False).ids)
