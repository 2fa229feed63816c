"""Full-text and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.suite.base import QUERIES, SQL, graph, query, text_query

_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def bm25(terms: list[str], where: str) -> str:
    """BM25 over documents as SQL; n1, n2, … are the terms' counts."""
    counts = ", ".join(f"len(list_filter(tok, lambda x: {t})) AS n{i + 1}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (n{i + 1} > 0) AS d{i + 1}" for i in range(len(terms)))
    parts = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len(tok) / a))" for i in range(1, len(terms) + 1))
    return f"WITH t AS (SELECT doc_id, {_TOK} AS tok FROM documents), c AS (SELECT doc_id, tok, {counts} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(len(tok)) AS a, {stats} FROM c) SELECT doc_id AS k, round({parts}, 6) AS s FROM c, s WHERE {where}"


def is_(word: str) -> str:
    return f"x = '{word}'"


text_query("search_term", "SEARCH ON doc_text('their') YIELD doc_id AS k, round(score(), 6) AS s", bm25([is_("their")], "n1 > 0"))
text_query("search_either", "SEARCH ON doc_text('erin shor') YIELD doc_id AS k, round(score(), 6) AS s", bm25([is_("erin"), is_("shor")], "n1 > 0 OR n2 > 0"))
text_query("search_boolean", "SEARCH ON doc_text('erin AND the NOT und') YIELD doc_id AS k, round(score(), 6) AS s", bm25([is_("erin"), is_("the")], "n1 > 0 AND n2 > 0 AND NOT list_contains(tok, 'und')"))
text_query("search_prefix", "SEARCH ON doc_text('shorth*') YIELD doc_id AS k, round(score(), 6) AS s", bm25(["starts_with(x, 'shorth')"], "n1 > 0"))
text_query("search_wildcard", "SEARCH ON doc_text('s?or*th') YIELD doc_id AS k, round(score(), 6) AS s", bm25(["regexp_full_match(x, 's.or.*th')"], "n1 > 0"))
text_query("search_fuzzy", "SEARCH ON doc_text('erinn~1') YIELD doc_id AS k, round(score(), 6) AS s", bm25(["levenshtein(x, 'erinn') <= 1"], "n1 > 0"))
text_query("search_field", "SEARCH ON doc_text('text:erin') YIELD doc_id AS k, matched_fields() AS f", f"SELECT doc_id AS k, ['text'] AS f FROM documents WHERE list_contains({_TOK}, 'erin')")
text_query("search_phrase", "SEARCH ON doc_text('\"of the\"') YIELD doc_id AS k", f"SELECT doc_id AS k FROM documents WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' of the ')")
text_query("search_range", "SEARCH ON doc_text('erin AND n_chars:[100 TO 900]') YIELD doc_id AS k", f"SELECT doc_id AS k FROM documents WHERE list_contains({_TOK}, 'erin') AND n_chars BETWEEN 100 AND 900")
text_query("search_top", "SEARCH ON doc_text('erin shor') YIELD doc_id AS k, round(score(), 6) AS s WHERE score() > 0.5 ORDER BY score() DESC, doc_id LIMIT 10", f'SELECT * FROM ({bm25([is_("erin"), is_("shor")], "n1 > 0 OR n2 > 0")}) WHERE s > 0.5 ORDER BY s DESC, k LIMIT 10')
text_query("search_snippet", "SEARCH ON doc_text('erin') YIELD doc_id AS k, length(snippet(text, 50)) <= 50 AS n, highlight(text) CONTAINS '<em>' AS h", f"SELECT doc_id AS k, true AS n, true AS h FROM documents WHERE list_contains({_TOK}, 'erin')")
text_query("match_text_predicate", "MATCH (d:documents) WHERE d.text CONTAINS 'erin' RETURN d.lang AS l, count(*) AS n", "SELECT lang AS l, count(*) AS n FROM documents WHERE contains(text, 'erin') GROUP BY 1")



def indexed_query(name: str, text: str, sql: str) -> None:
    """A search over postings that CREATE FULLTEXT INDEX writes first."""

    def run(spark, sf_dir):
        g = graph(spark, sf_dir)
        g.query("CREATE FULLTEXT INDEX postings ON documents(text)")
        return g.query(text)

    QUERIES[name], SQL[name] = run, sql


indexed_query("index_term", "SEARCH ON postings('their') YIELD doc_id AS k, round(score(), 6) AS s, round(field_score(text), 6) AS f, search_match(text) AS m", f"SELECT k, s, s AS f, true AS m FROM ({bm25([is_('their')], 'n1 > 0')})")
indexed_query("index_boolean", "SEARCH ON postings('erin AND the NOT und') YIELD doc_id AS k, round(score(), 6) AS s", bm25([is_("erin"), is_("the")], "n1 > 0 AND n2 > 0 AND NOT list_contains(tok, 'und')"))
indexed_query("index_prefix", "SEARCH ON postings('shorth*') YIELD doc_id AS k, round(score(), 6) AS s", bm25(["starts_with(x, 'shorth')"], "n1 > 0"))
indexed_query("index_wildcard", "SEARCH ON postings('s?or*th') YIELD doc_id AS k, round(score(), 6) AS s", bm25(["regexp_full_match(x, 's.or.*th')"], "n1 > 0"))
indexed_query("index_fuzzy", "SEARCH ON postings('erinn~1') YIELD doc_id AS k, round(score(), 6) AS s", bm25(["levenshtein(x, 'erinn') <= 1"], "n1 > 0"))
indexed_query("index_phrase", "SEARCH ON postings('\"of the\"') YIELD doc_id AS k", f"SELECT doc_id AS k FROM documents WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' of the ')")
indexed_query("index_negative", "SEARCH ON postings('NOT und') YIELD doc_id AS k", f"SELECT doc_id AS k FROM documents WHERE NOT list_contains({_TOK}, 'und')")
indexed_query("index_range", "SEARCH ON postings('erin AND n_chars:[100 TO 900]') YIELD doc_id AS k", f"SELECT doc_id AS k FROM documents WHERE list_contains({_TOK}, 'erin') AND n_chars BETWEEN 100 AND 900")

_Q = [0.5 if i % 3 == 0 else -0.25 for i in range(64)]
_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_L = str(_Q) + "::DOUBLE[]"


def nearest(metric: str, sql: str, order: str) -> None:
    index = {"cosine": "vec"}.get(metric, f"vec_{metric}")
    text_query(f"vector_{metric}", f"VECTOR SEARCH ON {index}($q) LIMIT 10 YIELD vec_id AS k, round(score(), 6) AS s", f"SELECT vec_id AS k, round({sql}, 6) AS s FROM embeddings ORDER BY {sql} {order}, 1 LIMIT 10", q=_Q)


nearest("cosine", f"list_cosine_similarity({_V}, {_L})", "DESC")
nearest("dot", f"list_dot_product({_V}, {_L})", "DESC")
nearest("euclid", f"list_distance({_V}, {_L})", "ASC")
nearest("manhattan", f"list_sum(list_transform(list_zip({_V}, {_L}), lambda p: abs(p[1] - p[2])))", "ASC")
text_query("vector_threshold", "VECTOR SEARCH ON vec($q) LIMIT 1000 WITH THRESHOLD 0.1 WHERE label < 5 YIELD vec_id AS k", f"SELECT vec_id AS k FROM embeddings WHERE label < 5 AND list_cosine_similarity({_V}, {_L}) >= 0.1 ORDER BY list_cosine_similarity({_V}, {_L}) DESC, 1 LIMIT 1000", q=_Q)
text_query("vector_match", "MATCH (e:embeddings) WHERE cosine_similarity(e.embedding, $q) > 0.05 RETURN e.label AS l, count(*) AS n", f"SELECT label AS l, count(*) AS n FROM embeddings WHERE list_cosine_similarity({_V}, {_L}) > 0.05 GROUP BY 1", q=_Q)


@query("SELECT vec_id AS k FROM embeddings WHERE vec_id = 7")
def vector_lookup(spark, sf_dir):
    return graph(spark, sf_dir).query("LOOKUP ON embeddings WHERE embeddings.vec_id == 7 YIELD embeddings.vec_id AS k").select(F.col("k"))
