"""Registered queries: a stable schema and, for those with SQL, the same rows as DuckDB on the smallest tables."""

import glob
import inspect
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from wordmill.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"
LIGHT = ["doc_tokens", "char_class_counts", "length_band", "stopword_anti", "longest_match", "sentence_split", "vocab_ids", "top_vocabulary", "doc_freq", "count_marginals", "chi_square_top", "chi_square_compat", "tfidf_top", "keywords_top", "nb_multinomial", "nb_bernoulli", "posterior_argmax", "cooc_pairs_unordered", "cooc_score_v1", "cooc_score_v3", "context_counts", "weighted_context", "sense_scores", "sense_expand", "neighbor_features", "bems_transitions", "next_char8", "seg_score", "entity_merge", "cosine_topk", "stream_scores", "cooc_score_v0", "cooc_score_v2", "cooc_evidence", "sweep_best_n", "seg_edits", "seg_oov", "bems_emissions", "length_filters", "packed_keys", "sense_scores_share", "event_windows", "adjacent_bigrams", "embedding_pairs_dot"]
LIGHT += re.findall(r'@query\("(\w+)"', inspect.getsource(fixtures))


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", LIGHT)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for file in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {file.split('/')[-1][:-8]} AS SELECT * FROM '{file}'")
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_is_batch(spark):
    from wordmill.streaming import scoring

    rows = catalogue.table(spark, SF, "conversations")
    batch = scoring.score_with_lists(rows, catalogue.POSITIVE, catalogue.NEGATIVE).select("conv_id", "turn", "n_tokens", "score")
    key = lambda r: tuple(r)
    assert sorted(map(key, batch.collect())) == sorted(map(key, catalogue.queries()["stream_scores"](spark, SF).collect()))
