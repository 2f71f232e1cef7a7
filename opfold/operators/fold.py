"""Applying operations: the last-write-wins fold and what goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opfold.functions.clock import encode
from opfold.functions.lww import stamp
from opfold.operators.log import arrivals, running
from opfold.schemas import RECORD_OPS, SCHEMA_OPS

RECORD = ("col_id", "record_id")


def winners(ops: DataFrame, key: tuple[str, ...] = RECORD, keep: tuple[str, ...] = ("op_type", "payload", "hlc", "src_node")) -> DataFrame:
    """The winning operation of every key: a partial and a final fold, one shuffle of winners only."""
    won = F.max_by(F.struct(*keep), stamp()).alias("w")
    return ops.groupBy(*key).agg(won).select(*key, *(F.col(f"w.{c}").alias(c) for c in keep))


def live(state: DataFrame) -> DataFrame:
    return state.filter(F.col("op_type") != "delete")


def merge_versions(versions: DataFrame, ops: DataFrame) -> DataFrame:
    """The versions table after more operations: same fold over both."""
    fresh = ops.select(*RECORD, "hlc", "src_node", (F.col("op_type") == "delete").alias("deleted"), F.col("created").alias("updated"))
    return winners(versions.unionByName(fresh), keep=("hlc", "src_node", "deleted", "updated"))


def applied(ops: DataFrame) -> DataFrame:
    """Per collection how many operations win at the moment they arrive, and how many came."""
    before = Window.partitionBy(*RECORD).orderBy("created", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    judged = ops.withColumn("__best", F.max(stamp()).over(before))
    wins = F.col("__best").isNull() | (stamp() > F.col("__best"))
    return judged.groupBy("col_id").agg(F.count_if(wins).alias("applied"), F.count("*").alias("received"))


def segments(ops: DataFrame, by: str = "src_node") -> DataFrame:
    """Batches between schema operations: a schema operation ends one and begins the next."""
    is_schema = F.col("op_type").isin(*SCHEMA_OPS)
    return running(ops.withColumn("barrier", is_schema), [by], arrivals(), ["created", "event_id"], is_schema.cast("long"), "segment")


def poisoned(payload: Column) -> Column:
    """Text that is there but isn't JSON."""
    return (payload != "") & F.try_parse_json(payload).isNull()


def split_poisoned(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The operations that can be applied, and the dead letters."""
    marked = ops.withColumn("__bad", F.col("op_type").isin("upsert", "col_upsert") & F.coalesce(poisoned(F.col("payload")), F.lit(False)))
    return marked.filter("not __bad").drop("__bad"), marked.filter("__bad").drop("__bad")


def schema_changes(ops: DataFrame) -> DataFrame:
    """Schema operations by collection in clock order; those that repeat the content before change only the version."""
    own = ops.filter(F.col("op_type").isin(*SCHEMA_OPS)).withColumn("content", F.sha2("payload", 256))
    order = Window.partitionBy("record_id").orderBy("hlc", "src_node")
    return own.withColumn("changes", ~F.col("content").eqNullSafe(F.lag("content").over(order)))


def schema_effects(ops: DataFrame, catalog: DataFrame, versions: DataFrame) -> DataFrame:
    """Schema operations with what each does as it arrives: ``change``, ``version`` (the content is there already) or ``none`` (something newer is).

    catalog: id, name, content (JSON); the local side of a collection is found
    by id, then name. versions: record_id, hlc, src_node. The content that an
    operation meets is that of the newest before it, else the local one; the
    payload is compared without white space around it.
    """
    own = resolve_collection(ops.filter(F.col("op_type").isin(*SCHEMA_OPS)), catalog)
    local = catalog.select(F.col("id").alias("local_col_id"), canonical(F.col("content")).alias("__local"))
    known = versions.groupBy("record_id").agg(F.max(stamp()).alias("__known"))
    text = F.when(F.col("op_type") == "col_upsert", F.regexp_replace("payload", r"^\s+|\s+$", ""))
    before = Window.partitionBy("record_id").orderBy("created", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    met = own.join(local, "local_col_id", "left").join(known, "record_id", "left").withColumns({"__text": text, "__new": F.col("__known").isNull() | (stamp() > F.col("__known"))})
    held = F.max(F.when(F.col("__new"), F.struct(stamp().alias("at"), canonical(F.col("__text")).alias("content")))).over(before)
    judged = met.withColumn("__held", held)
    wins = F.col("__new") & (F.col("__held").isNull() | (stamp() > F.col("__held.at")))
    same = F.col("__text") == F.when(F.col("__held").isNull(), F.col("__local")).otherwise(F.col("__held.content"))
    effect = F.when(~wins, "none").when(F.coalesce(same, F.lit(False)), "version").otherwise("change")
    return judged.select(*ops.columns, "local_col_id", effect.alias("effect"))


def merge_fields(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fields (collection, id, name, type, system) of imported schemas: a local field's id stays where name and type agree, local system fields are never lost.

    Ids and names are unique in a collection on either side.
    """
    lost = existing.join(incoming.select("collection", "id"), ["collection", "id"], "left_anti")
    old = lost.select("collection", "name", "type", F.col("id").alias("__id"))
    taken = incoming.join(old, ["collection", "name", "type"], "left").select("collection", F.coalesce("__id", "id").alias("id"), "name", "type", "system")
    return taken.unionByName(lost.filter("system").join(incoming.select("collection", "name", "type"), ["collection", "name", "type"], "left_anti").select("collection", "id", "name", "type", "system"))


def resolve_collection(ops: DataFrame, catalog: DataFrame) -> DataFrame:
    """The local collection of every operation: by id, else by name; null if unknown."""
    by_id = catalog.select(F.col("id").alias("__i"), F.col("id").alias("__by_id"))
    by_name = catalog.select(F.col("name").alias("__n"), F.col("id").alias("__by_name"))
    found = ops.join(by_id, ops.col_id == F.col("__i"), "left").join(by_name, F.col("col_name") == F.col("__n"), "left")
    return found.withColumn("local_col_id", F.coalesce("__by_id", "__by_name")).drop("__i", "__n", "__by_id", "__by_name")


def parked(ops: DataFrame, catalog: DataFrame, most: int) -> DataFrame:
    """Operations of unknown collections, the last ``most`` by arrival."""
    unknown = resolve_collection(ops, catalog).filter(F.col("local_col_id").isNull() & F.col("op_type").isin(*RECORD_OPS)).drop("local_col_id")
    return unknown.orderBy(F.desc("created"), F.desc("event_id")).limit(most)


def retry_parked(waiting: DataFrame, catalog: DataFrame, schema_ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parked operations that can be applied, now that schema operations came, and those that go on waiting.

    A collection whose newest schema operation is no deletion is known, under
    its id and, where one is given, its name.
    """
    newest = live_schema(schema_ops).select(F.col("record_id").alias("id"), F.col("col_name").alias("name"))
    known = catalog.select("id", "name").unionByName(newest.join(catalog.select("id"), "id", "left_anti")).dropDuplicates(["id"])
    # a name may be carried by several collections: the least id
    names = known.filter("name <> ''").groupBy(F.col("name").alias("__n")).agg(F.min("id").alias("__by_name"))
    by_id = waiting.join(known.select(F.col("id").alias("__by_id")), F.col("col_id") == F.col("__by_id"), "left")
    found = by_id.join(names, F.col("col_name") == F.col("__n"), "left").select(*waiting.columns, F.coalesce("__by_id", "__by_name").alias("local_col_id"))
    return found.filter("local_col_id is not null"), found.filter("local_col_id is null").drop("local_col_id")


def live_schema(ops: DataFrame) -> DataFrame:
    """The newest schema operation of every collection that isn't deleted."""
    own = ops.filter(F.col("op_type").isin(*SCHEMA_OPS))
    return winners(own, ("record_id",), ("op_type", "col_name", "payload", "hlc", "src_node")).filter("op_type = 'col_upsert'")


def replicated(catalog: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Collections that replicate: no views, not excluded by name or id."""
    return catalog.filter(~F.col("is_view") & ~F.col("name").isin(*excluded) & ~F.col("id").isin(*excluded))


def capture(changes: DataFrame, node: str, local_seq: int, block: int | Column = 1 << 16) -> DataFrame:
    """Operations for local changes (record_id, change_no, ms, deleted, fields struct): full row images, in order.

    The clock ticks on from change to change and jumps to the wall (ms) when
    that is ahead, so value i is the greatest of ``ms_j * 65536 + i - j`` over
    all j up to i. Numbers and greatest values are found in blocks, of which
    only one row each is put in order: so many change numbers, or a column that
    never falls as they rise.
    """
    own = changes.withColumn("__b", F.expr(f"change_no div {block}") if isinstance(block, int) else block)
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    within = Window.partitionBy("__b").orderBy("change_no")
    counts = own.groupBy("__b").agg(F.count("*").alias("__n"))
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = own.join(offsets, "__b").withColumn("__i", F.col("__before") + F.row_number().over(within)).withColumn("__x", F.col("ms").cast("long") * 65536 - F.col("__i"))
    tops = numbered.groupBy("__b").agg(F.max("__x").alias("__top")).select("__b", F.max("__top").over(earlier).alias("__reached"))
    tick = F.col("__i") + F.greatest(F.max("__x").over(within.rowsBetween(Window.unboundedPreceding, 0)), "__reached")
    return numbered.join(tops, "__b").select(
        F.lit(node).alias("src_node"),
        (F.lit(local_seq) + F.col("__i")).cast("long").alias("src_seq"),
        encode(F.shiftright(tick, 16), tick % 65536).alias("hlc"),
        F.when(F.col("deleted"), "delete").otherwise("upsert").alias("op_type"),
        "col_id",
        "record_id",
        F.when(F.col("deleted"), "").otherwise(F.to_json("fields")).alias("payload"),
    )


def overlay(base: DataFrame, patches: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Records with JSON patches laid over them: only the fields that a patch names change, an explicit null included."""
    p = patches.select(F.col(key).alias("__k"), F.col("payload").alias("__p"))
    there = {f: F.array_contains(F.json_object_keys("__p"), f) for f in fields}
    new = {f: F.get_json_object("__p", f"$.{f}").try_cast(kind) for f, kind in fields.items()}
    joined = base.join(p, F.col(key) == F.col("__k"), "left")
    return joined.select(key, *(F.when(F.coalesce(there[f], F.lit(False)), new[f]).otherwise(F.col(f)).alias(f) for f in fields))


def export(records: DataFrame, key: str, fields: list[str], file_fields: list[str]) -> DataFrame:
    """Full row images as JSON, and the file names of each file field (single names or lists; empty ones left out)."""
    kinds = dict(records.dtypes)
    lists = [F.filter(F.col(f) if kinds[f].startswith("array") else F.array(f), lambda n: n.isNotNull() & (n != "")) for f in file_fields]
    files = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, file_fields)), F.array(*lists)), lambda _, names: F.size(names) > 0)
    return records.select(F.col(key).cast("string").alias("record_id"), F.to_json(F.struct(*fields)).alias("payload"), files.alias("files"))


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no white space, the same for equal contents; null if malformed."""
    return F.to_json(F.try_parse_json(text))


def adopt_clocks(candidates: DataFrame) -> DataFrame:
    """The highest of several known clock values and sequences of a node, one row; clocks compare as text."""
    return candidates.agg(F.max("hlc").alias("hlc"), F.max("seq").alias("seq"))
