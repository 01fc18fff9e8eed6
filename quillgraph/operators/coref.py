"""Coreference: clusters, nearest antecedents and the resolution chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocab
from quillgraph.operators.cut import shuffled
from quillgraph.operators.resolve import resolve_surface
from quillgraph.operators.spans import WIDTH, binned


def tightest_cluster(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """(document_id, start_char, end_char, surfaces): the cluster of a mention's own span, else of the shortest span around it."""
    c = binned(clusters).select(F.col("document_id").alias("__d"), F.col("bin").alias("__bin"), F.col("start_char").alias("__a"), F.col("end_char").alias("__b"), "surfaces")
    m = mentions.select("document_id", "start_char", "end_char").withColumn("bin", F.floor(F.col("start_char") / WIDTH))
    inside = m.join(shuffled(c), (F.col("document_id") == F.col("__d")) & (F.col("bin") == F.col("__bin")) & (F.col("__a") <= F.col("start_char")) & (F.col("end_char") <= F.col("__b")))
    best = F.min_by("surfaces", F.struct(F.col("__b") - F.col("__a"), "__a"))
    return inside.groupBy("document_id", "start_char", "end_char").agg(best.alias("surfaces"))


def cluster_entity(clusters: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(key columns, entity_id): the longest surface of a cluster that resolves; the first of several as long."""
    keys = [c for c in clusters.columns if c != "surfaces"]
    rows = clusters.select(*keys, F.posexplode("surfaces").alias("pos", "text"))
    found = resolve_surface(rows, lexicon).where("entity_id IS NOT NULL")
    return found.groupBy(*keys).agg(F.min_by("entity_id", F.struct(-F.length("text"), "pos")).alias("entity_id"))


def allowed_types(head: Column) -> Column:
    """The types that a reference with this head word can stand for; unknown heads can stand for any, plural pronouns never for a person."""
    table = F.create_map(*(x for k, v in vocab.EXPECTED_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    wanted = F.coalesce(F.element_at(table, F.lower(head)), F.array(*map(F.lit, vocab.ENTITY_TYPES)))
    return F.when(F.lower(head).isin(*vocab.PLURAL_PRONOUNS), F.array_remove(wanted, "PERSON")).otherwise(wanted)


def nearest_antecedent(references: DataFrame, named: DataFrame) -> DataFrame:
    """(document_id, start_char, entity_id) of the nearest earlier named mention of a fitting type, one of the same sentence before any other.

    One pass in the order of the text: windows carry the last mention of every
    type along, of the sentence and of the document, and a reference chooses
    among those. ``references`` has document_id, start_char, sentence_index,
    head; ``named`` has document_id, start_char, sentence_index, entity_id,
    entity_type, text. Of mentions at one place the first id counts.
    """
    n = named.select("document_id", "start_char", "sentence_index", "entity_id", "entity_type", "text", F.lit(None).cast("string").alias("head"), F.lit(1).alias("named"))
    r = references.select("document_id", "start_char", "sentence_index", F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("text"), "head", F.lit(0).alias("named"))
    order = ["start_char", "named", F.desc("entity_id"), F.desc("text")]
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mention = F.struct((-F.col("start_char")).alias("back"), "entity_id")

    def latest(*keys: str) -> Column:
        """The last mention of each type."""
        return F.array(*(F.struct(F.lit(t).alias("type"), F.last(F.when(F.col("entity_type") == t, mention), ignorenulls=True).over(so_far(*keys)).alias("m")) for t in vocab.ENTITY_TYPES))

    rows = n.unionByName(r).withColumns({"all": latest("document_id"), "near": latest("document_id", "sentence_index")}).where("named = 0")
    rows = rows.withColumn("types", allowed_types(F.col("head")))
    best = lambda c: F.array_min(F.transform(F.filter(c, lambda x: x["m"].isNotNull() & F.array_contains(F.col("types"), x["type"])), lambda x: x["m"]))
    found = rows.select("document_id", "start_char", F.coalesce(best("near"), best("all"))["entity_id"].alias("entity_id"))
    return found.where("entity_id IS NOT NULL").distinct()


def resolution_chain(mentions: DataFrame) -> DataFrame:
    """Source and entity of each mention from what each layer found.

    Names resolve by lexicon or not at all. References resolve by declared
    description, then by cluster, then by antecedent; a description that a
    cluster contradicts is a conflict. Columns read: is_named, alias_id,
    description_id, cluster_id, antecedent_id.
    """
    c = F.col
    source = (
        F.when(c("is_named") & c("alias_id").isNotNull(), "ALIAS")
        .when(c("is_named"), "NONE")
        .when(c("description_id").isNotNull(), "ALIAS")
        .when(c("cluster_id").isNotNull(), "FASTCOREF")
        .when(c("antecedent_id").isNotNull(), "ANTECEDENT")
        .otherwise("NONE")
    )
    entity = F.when(c("is_named"), c("alias_id")).otherwise(F.coalesce("description_id", "cluster_id", "antecedent_id"))
    conflict = ~c("is_named") & F.coalesce(c("description_id") != c("cluster_id"), F.lit(False))
    return mentions.withColumns({"resolution_source": source, "entity_id": entity, "conflict": conflict})
