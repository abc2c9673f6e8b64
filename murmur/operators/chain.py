"""Hash chains per tenant: append, verify, heads, segments.

Two chains use this module: sealed evidence and the audit log. They differ in the domain
tag and in the fields hashed after the previous hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import ids, text
from murmur.functions.moments import rfc3339_micros
from murmur.operators.neighbours import in_sequence, with_previous

# The algorithm name inside the preimage and the hash before the first entry.
ALGORITHM = "sha256"
GENESIS = "0" * 64


@dataclass(frozen=True)
class ChainFormat:
    """The domain tag and the hashed fields, in order, after tenant, index and previous hash.

    Chains written elsewhere verify with the tag they were written with.
    """

    tag: str
    fields: tuple[str, ...]
    #: Fields that have to be SHA-256 digests in lower-case hexadecimal.
    digests: tuple[str, ...] = ()


EVIDENCE = ChainFormat(
    "evidence-chain-v1", ("manifest_sha256", "bundle_id"), digests=("manifest_sha256",)
)
#: ``reason`` is explanatory text and not hashed.
AUDIT = ChainFormat(
    "audit-chain-v1",
    ("entry_id", "actor_id", "action", "resource_type", "resource_id", "outcome",
     "occurred_at_text"),
)


def with_occurred_text(entries: DataFrame) -> DataFrame:
    """The instant as hashed: UTC, six decimals."""
    return entries.withColumn("occurred_at_text", rfc3339_micros(F.col("occurred_at")))


def entry_digest(fmt: ChainFormat):
    """Recomputed ``entry_hash`` as a column."""
    return ids.prefixed_digest(
        F.lit(fmt.tag),
        F.col("algorithm"),
        F.col("tenant_id"),
        F.col("chain_index").cast("string"),
        F.col("prev_hash"),
        *[F.col(f) for f in fmt.fields],
    )


def acceptable(fmt: ChainFormat) -> Column:
    """A tenant and all hashed fields are there, and digests have the form of one."""
    out = F.col("tenant_id").isNotNull()
    for field in fmt.fields:
        out = out & F.col(field).isNotNull()
        if field in fmt.digests:
            out = out & text.is_digest(F.col(field))
    return F.coalesce(out, F.lit(False))


def refused_entries(rows: DataFrame, fmt: ChainFormat | None = None) -> DataFrame:
    """Rows that never enter the chain: a hashed field is missing, or no digest."""
    return rows.where(~acceptable(fmt or EVIDENCE))


def append(
    rows: DataFrame, order: list[str], fmt: ChainFormat, heads: DataFrame | None = None
) -> DataFrame:
    """New entries, linked onto each tenant's head in the given order.

    Each hash needs the one before, so a tenant's new rows are hashed one after the other.
    That is what the chain is for and cannot be split; but the fold streams over a sorted
    partition with constant memory, takes only the rows that are new, and carries just the
    hashed fields. Rows of :func:`refused_entries` are left out, never linked.
    """
    lean = rows.where(acceptable(fmt)).select("tenant_id", *order, *[f for f in fmt.fields if f not in order])
    if heads is not None:
        lean = lean.join(
            heads.select(
                "tenant_id",
                F.col("chain_index").alias("head_index"),
                F.col("entry_hash").alias("head_hash"),
            ),
            "tenant_id",
            "left",
        )
        lean = lean.withColumn("head_index", F.coalesce("head_index", F.lit(-1).cast("long")))
        lean = lean.withColumn("head_hash", F.coalesce("head_hash", F.lit(GENESIS)))
    kept = [lean.schema[c] for c in ["tenant_id", *order] + [f for f in fmt.fields if f not in order]]
    schema = T.StructType(
        [
            *kept,
            T.StructField("chain_index", T.LongType()),
            T.StructField("prev_hash", T.StringType()),
            T.StructField("entry_hash", T.StringType()),
            T.StructField("algorithm", T.StringType()),
        ]
    )
    names = [f.name for f in kept]
    tag, fields, onto_heads = fmt.tag, fmt.fields, heads is not None

    def prefixed(*values: str) -> bytes:
        return b"".join(len(v).to_bytes(8, "big") + v for v in (s.encode() for s in values))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, index, head = None, -1, GENESIS
        for batch in batches:
            links = []
            hashed = zip(*[batch[f].tolist() for f in fields], strict=True)
            owners = batch["tenant_id"].tolist()
            for row, (owner, values) in enumerate(zip(owners, hashed, strict=True)):
                if owner != tenant:
                    tenant, index, head = owner, -1, GENESIS
                    if onto_heads:
                        index, head = int(batch["head_index"].iat[row]), batch["head_hash"].iat[row]
                index += 1
                digest = hashlib.sha256(
                    prefixed(tag, ALGORITHM, owner, str(index), head, *map(str, values))
                ).hexdigest()
                links.append((index, head, digest, ALGORITHM))
                head = digest
            out = batch[names].reset_index(drop=True)
            linked = pd.DataFrame(
                links, columns=["chain_index", "prev_hash", "entry_hash", "algorithm"]
            )
            yield pd.concat([out, linked], axis=1)

    return in_sequence(lean, ["tenant_id"], order).mapInPandas(fold, schema)


def verify(entries: DataFrame, fmt: ChainFormat) -> DataFrame:
    """Each entry with flags: hash_ok, genesis_ok, index_ok, link_ok and ``problems``.

    Hashes are recomputed per row; links compare with the preceding entry. Both run in
    parallel inside one tenant.
    """
    carried = ["chain_index", "entry_hash"]
    rows = with_previous(entries, ["tenant_id"], "chain_index", carried)
    previous = F.col("previous")
    first = previous.isNull()
    # The recomputed hash belongs to the row, so it is not carried through the shuffle.
    # What cannot be checked, as a field is missing, is not sound.
    sound = lambda condition: F.coalesce(condition, F.lit(False))
    starts = F.col("chain_index").isNotNull() & F.col("prev_hash").isNotNull()
    checked = rows.select(
        *entries.columns,
        sound(F.col("entry_hash") == entry_digest(fmt)).alias("hash_ok"),
        sound(~first | (starts & (F.col("chain_index") != 0)) | (F.col("prev_hash") == GENESIS))
        .alias("genesis_ok"),
        sound(first | (F.col("chain_index") == previous["chain_index"] + 1)).alias("index_ok"),
        sound(first | (F.col("prev_hash") == previous["entry_hash"])).alias("link_ok"),
        previous["chain_index"].alias("previous_index"),
    )
    problems = F.array_compact(
        F.array(
            F.when(~F.col("hash_ok"), F.lit("hash does not match contents")),
            F.when(~F.col("genesis_ok"), F.lit("does not start from the genesis hash")),
            F.when(~F.col("index_ok"), F.lit("entries are missing or reordered")),
            F.when(~F.col("link_ok"), F.lit("does not link to the entry before")),
        )
    )
    return checked.withColumn("problems", problems)


def verify_summary(checked: DataFrame) -> DataFrame:
    """Per tenant: entries, broken entries and the first of them."""
    broken = F.size("problems") > 0
    return checked.groupBy("tenant_id").agg(
        F.count("*").alias("entries"),
        F.count_if(broken).alias("broken"),
        F.min(F.when(broken, F.col("chain_index"))).alias("first_broken"),
    )


def foreign_entries(segment: DataFrame, by: str = "segment_id") -> DataFrame:
    """Entries of a segment that belong to another tenant than its first entry."""
    owner = segment.groupBy(by).agg(
        F.min_by("tenant_id", F.struct("position", "tenant_id")).alias("owner")
    )
    return segment.join(owner, by).where(F.col("tenant_id") != F.col("owner"))


def heads(entries: DataFrame) -> DataFrame:
    """The latest entry of each tenant."""
    return entries.groupBy("tenant_id").agg(
        F.max_by(F.struct(*[c for c in entries.columns if c != "tenant_id"]), "chain_index")
        .alias("h")
    ).select("tenant_id", "h.*")


def segment(entries: DataFrame, first: int, last: int) -> DataFrame:
    """Entries between two indexes; order is by ``chain_index``."""
    return entries.where(F.col("chain_index").between(first, last))


def latest_anchors(anchors: DataFrame) -> DataFrame:
    order = F.struct("anchored_at", "chain_index")
    return anchors.groupBy("tenant_id").agg(
        F.max_by(F.struct("chain_index", "authority_url", "anchored_at"), order).alias("a")
    ).select("tenant_id", "a.*")


def anchor_lag(tenants: DataFrame, entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """empty, never, current or behind, per tenant, and by how many entries."""
    head = entries.groupBy("tenant_id").agg(F.max("chain_index").alias("head_index"))
    last = latest_anchors(anchors).select(
        "tenant_id", F.col("chain_index").alias("anchored_index")
    )
    behind = F.col("head_index") - F.col("anchored_index")
    state = (
        F.when(F.col("head_index").isNull(), F.lit("empty"))
        .when(F.col("anchored_index").isNull(), F.lit("never"))
        .when(behind == 0, F.lit("current"))
        .otherwise(F.lit("behind"))
    )
    return (
        tenants.select("tenant_id")
        .join(head, "tenant_id", "left")
        .join(last, "tenant_id", "left")
        .select("tenant_id", "head_index", "anchored_index", behind.alias("behind"),
                state.alias("state"))
    )


def due_for_anchor(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Heads that are not the latest anchored entry."""
    last = latest_anchors(anchors).select("tenant_id", "chain_index")
    return heads(entries).join(last, ["tenant_id", "chain_index"], "left_anti")
