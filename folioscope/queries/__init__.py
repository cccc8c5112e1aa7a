"""Registered queries: each applies an operator to tables derived from the given ones, with its SQL.

The stand-ins for a section corpus, its graph and its history are plain SQL over the
given tables, the same text for Spark and for the SQL that results are held against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> (views it needs, text); {t} is a given table, other views are used by name
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus": ((), """
SELECT concat('D', doc_id) AS id, concat(source, '.', lang, '.', doc_id) AS doc_no, substring(text, 1, 40) AS title,
       lang AS type, text AS content, doc_id AS ord FROM {documents}"""),
    "docs": ((), """
SELECT concat('R', r_regionkey) AS id, concat('A.', r_regionkey + 1) AS doc_no, r_name AS title, 'Region' AS type, 1 AS depth,
       CAST(NULL AS STRING) AS parent_id, '' AS content, CAST(1000000000000 AS BIGINT) + r_regionkey AS ord FROM {region}
UNION ALL
SELECT concat('N', n_nationkey), concat('A.', n_regionkey + 1, '.', n_nationkey + 1), n_name, 'Nation', 2,
       concat('R', n_regionkey), '', CAST(2000000000000 AS BIGINT) + n_nationkey FROM {nation}
UNION ALL
SELECT concat('C', c_custkey), concat('A.', n_regionkey + 1, '.', n_nationkey + 1, '.', c_custkey + 1), c_name, c_mktsegment, 3,
       concat('N', n_nationkey), d.text, CAST(3000000000000 AS BIGINT) + c_custkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey CROSS JOIN (SELECT count(*) AS n FROM {documents}) nd JOIN {documents} d ON d.doc_id = c_custkey % nd.n
UNION ALL
SELECT concat('S', s_suppkey), concat('A.', n_regionkey + 1, '.', n_nationkey + 1, '.0.6.', s_suppkey + 1), s_name, 'Active Data', 3,
       concat('N', n_nationkey), '', CAST(3500000000000 AS BIGINT) + s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT concat('O', o_orderkey), concat('A.', n_regionkey + 1, '.', n_nationkey + 1, '.', c_custkey + 1, '.', o_orderkey + 1),
       concat('Order ', o_orderkey), o_orderpriority, 4, concat('C', c_custkey), '', CAST(4000000000000 AS BIGINT) + o_orderkey
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""),
    "entities": (("docs",), """
SELECT id, concat(lower(replace(title, '#', '-')), '-', lower(id)) AS slug, title AS name,
       CASE substring(id, 1, 1) WHEN 'C' THEN 'customer' WHEN 'S' THEN 'supplier' WHEN 'N' THEN 'nation' ELSE 'region' END AS entity_type,
       CASE WHEN substring(id, 1, 1) = 'C' THEN type END AS subtype, id AS defining_doc_id FROM docs WHERE depth <= 3
UNION ALL
SELECT concat('P', p_partkey), concat(replace(p_name, ' ', '-'), '-p', p_partkey), p_name, 'part', p_type, CAST(NULL AS STRING) FROM {part}"""),
    "edges": (("docs",), """
SELECT parent_id AS from_id, 'doc' AS from_type, id AS to_id, 'doc' AS to_type, 'parent_of' AS edge_type, doc_no AS source FROM docs WHERE parent_id IS NOT NULL
UNION ALL SELECT id, 'doc', id, 'entity', 'defines_entity', doc_no FROM docs WHERE depth <= 3
UNION ALL SELECT id, 'entity', parent_id, 'entity', 'located_in', doc_no FROM docs WHERE depth = 3
UNION ALL SELECT DISTINCT concat('S', l_suppkey), 'entity', concat('P', l_partkey), 'entity', 'supplies', CAST(NULL AS STRING) FROM {lineitem}
UNION ALL SELECT DISTINCT concat('S', l_suppkey), 'entity', concat('O', l_orderkey), 'doc', 'responsible_party_for', CAST(NULL AS STRING) FROM {lineitem}"""),
    "commits": ((), """
SELECT day, CAST(row_number() OVER (ORDER BY day) AS INT) AS commit_seq FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM {events}) x"""),
    "history": (("commits",), """
SELECT event_id, concat('D', user_id) AS doc_id, day AS date, ts, commit_seq, substring(md5(CAST(day AS STRING)), 1, 7) AS commit_hash,
       CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS change_type,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS pr_number, value, user_id, props
FROM {events} JOIN commits ON CAST(ts AS DATE) = day"""),
    "cards": ((), """
SELECT concat('00000000-0000-4000-8000-', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS id, concat('A.', o_custkey, '.', substring(o_orderpriority, 1, 1)) AS doc_no,
       concat('After [this](00000000-0000-4000-8000-', lpad(CAST(o_orderkey + 1 AS STRING), 12, '0'), '), [again](00000000-0000-4000-8000-', lpad(CAST(o_orderkey + 1 AS STRING), 12, '0'),
              ') and [that](00000000-0000-4000-8000-', lpad(CAST(o_custkey AS STRING), 12, '0'), ')') AS content FROM {orders} WHERE o_orderstatus <> 'P'"""),
    "card_edges": ((), """
SELECT o_orderkey AS from_id, o_custkey AS to_id, CASE WHEN o_orderstatus <> 'O' THEN concat('A.', o_custkey, '.', substring(o_orderpriority, 1, 1)) END AS source FROM {orders}"""),
    "vectors": ((), """SELECT concat('D', vec_id) AS doc_id, embedding, label FROM {embeddings}"""),
    "prev": (("corpus",), """SELECT id, title, content, concat('a/', ord) AS path FROM corpus WHERE ord % 10 <> 0"""),
    "curr": (("corpus",), """
SELECT id, title, CASE WHEN ord % 7 = 0 THEN concat(content, ' edited') ELSE content END AS content,
       concat(CASE WHEN ord % 13 = 0 THEN 'b/' ELSE 'a/' END, ord) AS path FROM corpus WHERE ord % 11 <> 0"""),
}


#: Views that are written once for a query and read again, as its operators use them many times.
STORED = {"sections"}
#: A table that a view reads dealt by what all rows that it makes distinct begin with: tasks hold them once dealt, not before and after.
DEALT = {"edges": {"lineitem": "concat('S', l_suppkey)"}}
#: Parts into which what a task reads of such a table is dealt, so that a part's rows and their strings are small in memory however large the table is.
PARTS = 8


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key into a number of parts that grows with the table."""
    return df.repartition(PARTS * max(1, df.rdd.getNumPartitions()), F.expr(key))


class Views:
    """The given tables of a folder and the stand-ins derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
            else:
                needs, text = VIEWS[name]
                for view in needs:
                    text = text.replace(f" {view} ", f" {{{view}}} ").replace(f" {view}\n", f" {{{view}}}\n")
                    text = text + " " if not text.endswith(view) else text[: -len(view)] + f"{{{view}}}"
                used = [n for n in (*TABLES, *VIEWS) if f"{{{n}}}" in text]
                keys = DEALT.get(name, {})
                made = self.spark.sql(text, **{n: dealt(getattr(self, n), keys[n]) if n in keys else getattr(self, n) for n in used})
                self._made[name] = stored(made, name) if name in STORED else made
        return self._made[name]

    def kept(self, *names: str) -> dict[str, DataFrame]:
        """Views written once, in this order; what is derived from them later reads them there."""
        for name in names:
            self._made[name] = stored(getattr(self, name), name)
        return {name: self._made[name] for name in names}


def prelude(*views: str) -> str:
    """WITH clauses that define views in SQL, those they need first."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    texts = []
    for v in order:
        text = VIEWS[v][1]
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        texts.append(f"{v} AS ({text})")
    return "WITH " + ",\n".join(texts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers a function of Views as a query; sql follows the views' WITH clauses (more clauses begin with a comma)."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = (prelude(*views) + "\n" if views else "") + sql
        return f

    return register
