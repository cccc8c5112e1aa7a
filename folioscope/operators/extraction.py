"""Entities, edges and addresses mined from sections by tables of rules.

A rule is a row: what it looks at, its pattern, and how what it finds is resolved. One
job runs all rules of a kind; a new rule is a new row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bounded, links, parent_key

EVM = r"(?<![0-9a-fA-F])0x[0-9a-fA-F]{40}(?![0-9a-fA-F])"
BASE58 = r"(?<![A-Za-z0-9])[1-9A-HJ-NP-Za-km-z]{43,44}(?![A-Za-z0-9])"
#: characters of a text before and after an address that say what it is
AROUND = 300
# fixed values: words that name a chain, in the order in which they count
CHAINS = (
    ("ethereum", "ethereum|mainnet"), ("base", "base"), ("arbitrum", "arbitrum|arb"), ("optimism", "optimism|op mainnet"),
    ("polygon", "polygon|matic"), ("avalanche", "avalanche|avax"), ("gnosis", "gnosis|xdai"),
)
# fixed values: what texts call an address's role
ROLES = {
    "multisig": "multi-?sig", "subproxy": "sub-?proxy", "hot-wallet": "hot[- ]wallet", "proxy": "(?<!sub)(?<!sub-)proxy", "registry": "registry",
    "oracle": "oracle|price[- ]feed", "treasury": "treasury", "buffer": "buffer", "reserve": "reserves?", "vesting": "vesting", "vault": "vault",
    "foundation": "foundation", "incentive-pool": r"incentive[\s-]+pool", "staking-rewards": r"staking[\s-]+rewards?", "signer": "signer",
    "delegate": "delegate", "executor": "executor", "controller": "controller",
}
# fixed values: token symbols, as they are written
TOKENS = ("USDS", "DAI", "SKY", "MKR", "sUSDS", "stUSDS", "USDC", "ETH", "WETH", "SPK", "GROVE", "KEEL", "OBEX", "PATTERN", "SKYBASE")


@dataclass(frozen=True)
class EdgeRule:
    """A section whose number or title fits has an edge to the section of its number without some segments, its parent, or its first link."""

    edge_type: str
    column: str
    pattern: str
    target: str  # strip, parent or link
    strip: int = 0


# fixed values: which sections point where
EDGE_RULES = (
    EdgeRule("annotates", "doc_no", r"\.(?:0\.[34]|[0-9]+\.var[0-9]+)(?:\.[0-9]+)?$", "parent"),
    EdgeRule("active_data_for", "doc_no", r"\.0\.6\.[0-9]+$", "strip", 3),
    EdgeRule("has_status", "title", "(?i)global activation status", "strip", 2),
    EdgeRule("located_at", "title", "(?i)instance configuration document location", "link"),
)


def rule_edges(docs: DataFrame, rules: tuple[EdgeRule, ...] = EDGE_RULES) -> DataFrame:
    """from_id, to_id and edge_type of all rules in one pass and one join on numbers."""
    first = F.get(links(F.col("content")), F.lit(0))
    found = F.array(*[
        F.when(F.col(r.column).rlike(r.pattern), F.struct(
            F.lit(r.edge_type).alias("edge_type"), (parent_key(F.col("doc_no"), r.strip) if r.target == "strip" else F.lit(None).cast("string")).alias("number"),
            {"parent": F.col("parent_id"), "link": first}.get(r.target, F.lit(None).cast("string")).alias("id"),
        )) for r in rules
    ])
    rows = docs.select(F.col("id").alias("from_id"), F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r"))
    by_no = docs.groupBy(F.col("doc_no").alias("number")).agg(F.max_by("id", "ord").alias("by_number"))
    resolved = rows.select("from_id", "r.edge_type", "r.number", "r.id").join(by_no, "number", "left").withColumn("to_id", F.coalesce("id", "by_number"))
    return resolved.where("to_id IS NOT NULL AND to_id <> from_id").select("from_id", "to_id", "edge_type")


def parent_edges(docs: DataFrame) -> DataFrame:
    return docs.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("parent_of").alias("edge_type"))


def citations(docs: DataFrame) -> DataFrame:
    """from_id, to_id of links to other sections, each pair once."""
    found = docs.select(F.col("id").alias("from_id"), F.explode(links(F.col("content"))).alias("to_id"))
    return found.where("from_id <> to_id").join(docs.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", F.lit("cites").alias("edge_type"))


def addresses(docs: DataFrame) -> DataFrame:
    """id, address, pos and around: each place of an address with the text near it; EVM addresses in lower case."""
    pattern = f"{EVM}|{BASE58}"
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    gaps = F.split("content", pattern, -1)
    rows = docs.select("id", "content", found.alias("found"), F.transform(gaps, lambda g: F.length(g)).alias("gaps")).where(F.size("found") > 0)
    rows = rows.select("id", "content", "gaps", "found", F.posexplode("found").alias("k", "raw"))
    upto = F.aggregate(F.slice("gaps", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("found", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + F.length(x))
    rows = rows.withColumn("pos", upto)
    start = F.greatest(F.col("pos") - AROUND, F.lit(0))
    return rows.select(
        "id", F.when(F.col("raw").startswith("0x"), F.lower("raw")).otherwise(F.col("raw")).alias("address"), "pos",
        F.substring("content", start + 1, F.col("pos") - start).alias("before"), F.substring("content", start + 1, F.col("pos") - start + F.length("raw") + AROUND).alias("around"),
    )


def _named(text: Column) -> Column:
    out = None
    for chain, words in CHAINS:
        hit = text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")
        out = F.when(hit, chain) if out is None else out.when(hit, chain)
    return out


def chain_of(before: Column) -> Column:
    """The chain that the text before an address names: in 'address on X is', else near, else farther; ethereum if none."""
    near = F.right(before, F.lit(120))
    phrase = F.regexp_extract(near, r"(?i)address\s+on\s+(?:the\s+)?(.{3,30}?)\s+is\s*$", 1)
    return F.coalesce(_named(phrase), _named(near), _named(before), F.lit("ethereum"))


def roles_of(around: Column) -> Column:
    return F.filter(F.array(*[F.when(around.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"), r) for r, p in ROLES.items()]), lambda r: r.isNotNull())


def tokens_of(around: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(around, F.lit(rf"(?<![A-Za-z0-9_])({'|'.join(TOKENS)})(?![A-Za-z0-9_])"), F.lit(1)))


# fixed values: patterns of the name of an address's owner in the text before it, the first that fits counts; words that are no names
LABEL_PATTERNS = (
    r"\baddress\s+of\s+(?:the\s+)?([A-Z][A-Za-z0-9 .&'’-]{2,60}?)\s+(?:is|on|at)\b",
    r"\b(?:the\s+)?([A-Z][A-Za-z0-9 .&'’-]{2,60}?)['’]?s?\s+address\s+(?:is|on)\b",
    r"\breward\s+address\s+for\s+(?:the\s+)?([A-Z][A-Za-z0-9 .&'’-]{2,60}?)\s+is\b",
    r"\b([A-Z][A-Za-z0-9 .&'’-]{2,60}?)\s+at\s+address\b",
    r"(?i)\b(?:Recipient|Multisig|Operator|Owner|Controller|Executor)\s*[:-]\s*([A-Z][A-Za-z0-9 .&'’-]{2,60})",
    r"\*\*([A-Z][A-Za-z0-9 .&'’-]{2,60}?)\*\*\s*[:-]",
)
NO_NAMES = ("the", "this", "that", "these", "those", "it")


def label_of(before: Column) -> Column:
    """The name that the 200 characters before an address give it."""
    near = F.right(before, F.lit(200))
    names = F.transform(F.array(*[F.regexp_extract(near, p, 1) for p in LABEL_PATTERNS]), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.get(F.filter(names, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*NO_NAMES)), F.lit(0))


def table_cells(docs: DataFrame) -> DataFrame:
    """id, address, cells, headers and column of addresses in lines of pipe tables; headers are the line above the last separator."""
    cut = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    w = Window.partitionBy("id").orderBy("n")
    lines = docs.select("id", F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    lines = lines.withColumn("separator", F.col("line").rlike(r"^\|[\s\-:|]+\|$")).withColumn("above", F.lag("line").over(w))
    lines = lines.withColumn("header", F.last(F.when(F.col("separator"), F.col("above")), ignorenulls=True).over(w))
    rows = lines.where(F.col("line").rlike(r"^\|.+\|$") & ~F.col("separator")).withColumn("raw", F.explode(F.regexp_extract_all("line", F.lit(f"{EVM}|{BASE58}"), F.lit(0))))
    column = F.regexp_count(F.expr("substring_index(line, raw, 1)"), F.lit(r"\|")) - 1
    address = F.when(F.col("raw").startswith("0x"), F.lower("raw")).otherwise(F.col("raw"))
    return rows.select("id", address.alias("address"), cut(F.col("line")).alias("cells"), cut(F.coalesce("header", F.lit(""))).alias("headers"), column.alias("column"))


def filled_labels(rows: DataFrame, *sources: DataFrame) -> DataFrame:
    """rows (address, label, ...) with missing labels from sources (address, name) in their order; names of one address are taken by text."""
    for k, source in enumerate(sources):
        named = source.where("name IS NOT NULL").groupBy("address").agg(F.min("name").alias(f"_name{k}"))
        rows = rows.join(named, "address", "left").withColumn("label", F.coalesce("label", f"_name{k}")).drop(f"_name{k}")
    return rows


def unlabelled(rows: DataFrame) -> DataFrame:
    """Addresses without a label, with the sections that name them, most named first."""
    return rows.where("label IS NULL").select("address", "chain", F.size("docs").alias("mentions"), "docs").orderBy(F.desc("mentions"), "address")


def annotated(docs: DataFrame) -> DataFrame:
    """One row for each address and chain with its roles, tokens, labels and the sections that name it."""
    rows = addresses(docs).select("id", "address", chain_of(F.col("before")).alias("chain"), roles_of(F.col("around")).alias("roles"), tokens_of(F.col("around")).alias("tokens"), label_of(F.col("before")).alias("label"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    chain = F.coalesce(F.min(F.when(F.col("chain") != "ethereum", F.col("chain"))), F.lit("ethereum"))
    return rows.groupBy("address").agg(chain.alias("chain"), union("roles").alias("roles"), union("tokens").alias("tokens"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("id")).alias("docs"))


def best_labels(rows: DataFrame, registry: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds label and aliases: the registry's name, else the longest label of the texts, else the contract's name; the rest are aliases.

    The registry has names by address (address, name), contracts by address and chain
    (address, chain, name); of several names of one key the least by text counts.
    """
    known = registry.groupBy("address").agg(F.min("name").alias("registry_name"))
    deployed = contracts.groupBy("address", "chain").agg(F.min("name").alias("contract_name"))
    named = rows.join(known, "address", "left").join(deployed, ["address", "chain"], "left")
    longest = F.get(F.array_sort(F.transform("labels", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(0))["x"]
    label = F.coalesce("registry_name", longest, "contract_name")
    every = F.filter(F.array_union("labels", F.array("registry_name", "contract_name")), lambda x: x.isNotNull())
    return named.withColumn("label", label).withColumn("aliases", F.array_sort(F.array_except(every, F.array("label")))).drop("registry_name", "contract_name")


def glossary(docs: DataFrame) -> DataFrame:
    """term, content, id and doc_no of definitions: Core sections under one titled Definitions, with the title above that as context."""
    homes = docs.where("title = 'Definitions'").select(F.col("id").alias("parent_id"), F.col("parent_id").alias("above"))
    titles = docs.select(F.col("id").alias("above"), F.col("title").alias("context"))
    return docs.where("type = 'Core'").join(homes, "parent_id").join(titles, "above", "left").select(F.lower("title").alias("term"), "content", "id", "doc_no", "context")


def first_entities(candidates: DataFrame) -> DataFrame:
    """Of candidates (slug, name, entity_type, phase, ord) with one slug the one of the earliest phase and order."""
    best = F.min_by(F.struct(*[c for c in candidates.columns if c != "slug"]), F.struct("phase", "ord"))
    return candidates.groupBy("slug").agg(best.alias("e")).select("slug", "e.*")


def term_in(content: Column, term: str) -> Column:
    return content.rlike(f"(?i){bounded(term)}")


