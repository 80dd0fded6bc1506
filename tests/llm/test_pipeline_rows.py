"""What the first stages of the pipeline do row by row, and the evidence that decides on a language."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import filters, language

EN = "the cat and the dog are not in the house today, and they will not be here with us in the morning "
DE = "der Hund und die Katze sind heute nicht in dem Haus, und sie werden auch morgen nicht bei uns sein "
RU = "кошка и собака сегодня не дома, и завтра утром их тоже не будет с нами в этом старом доме "
OTHER = "one quite different sentence tells that trains leave early from stations near rivers and lakes "
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("parts", [1, 5])
def test_each_row_has_its_own_language(spark, parts):
    rows = [(None, EN, "en"), (None, DE, "de"), (7, EN, "en"), (7, DE, "de"), (7, RU, "ru"), (8, RU, None), (9, None, "en"), (10, "", None), (11, "123 456", "de")]
    rows += [(100 + k, EN * 20, "en") for k in range(4)] + [(200 + k, DE * 20, "de") for k in range(4)]
    kept = corpus_pipeline.known_language(spark, documents(spark, rows).repartition(parts), "")
    assert kept.columns == corpus_pipeline.COLUMNS
    expected = [(i, t, lang, "s", len(t)) for i, t, lang in rows if t and t[:9] in (EN[:9], DE[:9])]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("parts", [1, 6])
def test_one_row_of_each_group_of_texts(spark, parts):
    near = EN + "once more"
    rows = [(5, EN, "en"), (5, EN, "en"), (5, OTHER, "en"), (3, near, "en"), (8, near, "en"), (None, EN, "en"), (None, EN, "en"), (6, DE, "de"), (9, None, "en"), (9, "", "en"), (4, "a b", "en")]
    kept = corpus_pipeline.one_of_near_duplicates(spark, documents(spark, rows).repartition(parts), "")
    assert kept.columns == corpus_pipeline.COLUMNS
    expected = [(3, near), (5, OTHER), (6, DE), (4, "a b"), (9, None), (9, ""), (None, EN), (None, EN)]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(expected, key=repr)


def test_members_are_exact_and_possible_members_lose_none(spark):
    df = spark.range(0, 5000, 1, 7).withColumnRenamed("id", "key").withColumn("_x", F.col("key") * 2)
    some = df.where("key % 3 = 0 or key % 64 = 63")
    exact = filters.members(df, filters.exact_members(some, "key"), "key")
    assert exact.columns == df.columns
    want = sorted(r.key for r in some.collect())
    assert sorted(r.key for r in exact.collect()) == want
    possible = sorted(r.key for r in filters.possible_members(df, some, "key").collect())
    assert set(want) <= set(possible) and len(possible) < len(want) + 50
    assert filters.possible_members(df, some.limit(0), "key").count() == 0
    plan = filters.possible_members(df, some, "key")._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def plain_fusion(logs, n, declared, hosts, suffixes):
    """Bayes' rule by loops: text, declaration, and a host's prior shrunk to its suffix's and that to all rows'."""
    size = len(logs[0])

    def norm(values):
        top = max(values)
        w = [math.exp(v - top) for v in values]
        return [x / sum(w) for x in w]

    p = [norm(row) for row in logs]
    said = [i for i in range(len(n)) if n[i] > 0]
    add = lambda rows, k: sum(p[i][k] for i in rows)
    total = [add(said, k) + 1.0 for k in range(size)]
    overall = [t / sum(total) for t in total]
    out = []
    for i in range(len(n)):
        of = [j for j in said if suffixes[j] == suffixes[i]]
        same = [j for j in said if hosts[j] == hosts[i]]
        like = [j for j in said if declared[j] == declared[i]]
        level = [(add(of, k) + language.SHRINK * overall[k]) / (len(of) + language.SHRINK) for k in range(size)] if same else overall
        rest = [max(add(same, k) - (p[i][k] if n[i] > 0 else 0.0), 0.0) for k in range(size)]
        prior = [(rest[k] + language.SHRINK * level[k]) / (sum(rest) + language.SHRINK) for k in range(size)]
        trust = [math.log((add(like, k) + 0.5) / (total[k] + 1.0)) if like else 0.0 for k in range(size)]
        out.append(norm([logs[i][k] + trust[k] + math.log(prior[k]) for k in range(size)]))
    return out


def test_evidence_is_fused_as_in_a_plain_version(spark):
    texts = [EN, DE, "the", "und", "", None, RU, EN[:30], DE[:25], "in"] * 4
    declared = ["de" if k % 7 == 0 else ["en", "de", None][k % 3] for k in range(40)]
    hosts = [f"https://h{k % 5}.{['com', 'de'][k % 2]}/p" if k % 9 else None for k in range(40)]
    rows = [(k, texts[k], declared[k], hosts[k], texts[k]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, url string, row string")
    model = language.fit_text_model(spark.createDataFrame([(EN, "en"), (DE, "DE")], "text string, lang string"), "text", "lang", ("de", "en"))
    found = {r.id: r for r in language.identified(df, model, "id", "text", F.col("declared"), F.col("url"), carry=("text", "row")).collect()}
    logs, n = language.evidence(model.logs, texts)
    host = [f"h{k % 5}.{['com', 'de'][k % 2]}" if k % 9 else "" for k in range(40)]
    plain = plain_fusion(logs.tolist(), n, [d or "" for d in declared], host, [h.rpartition(".")[2] if "." in h else "" for h in host])
    for k in range(40):
        best = int(np.argmax(plain[k]))
        assert found[k].confidence == pytest.approx(max(plain[k]), abs=1e-6)
        assert found[k].lang == ((["de", "en", "und"][best]) if n[k] else "und")
        assert found[k].row.text == texts[k] == found[k].row.row


def test_planted_wrong_declarations_do_not_win_over_long_texts(spark):
    rows = [(k, (EN if k % 2 else DE) * 3, ["en", "de"][k % 2] if k % 5 == 0 else ["de", "en"][k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, declared string")
    model = language.fit_text_model(spark.createDataFrame([(EN, "en"), (DE, "de")], "text string, lang string"), "text", "lang", ("de", "en"))
    found = {r.id: r.lang for r in language.identified(df, model, "id", "text", F.col("declared")).collect()}
    assert found == {k: "en" if k % 2 else "de" for k in range(60)}
