"""Exports: items with tags, reports, and sidecar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.operators.search import top_per_group


def export_rows(items: DataFrame, item_tags: DataFrame, min_score: float = 0.0) -> DataFrame:
    """S12. Every item with its tags at ``min_score`` or better, best first; items without any have an empty list.

    Of a tag given by several models the best score counts.
    """
    best = item_tags.where(F.col("score") >= min_score).groupBy("item_id", "tag").agg(F.max("score").alias("score"))
    lists = best.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "tag", "score"))).alias("t"))
    empty = F.array().cast("array<struct<s:double,tag:string,score:double>>")
    tags = F.transform(F.coalesce("t", empty), lambda x: F.struct(x["tag"].alias("name"), x["score"].alias("score")))
    return items.select("item_id", "path").join(lists, "item_id", "left").select("item_id", "path", tags.alias("tags"))


def export_json(items: DataFrame, item_tags: DataFrame, path: str, min_score: float = 0.0) -> None:
    """S12. One JSON object per item."""
    export_rows(items, item_tags, min_score).write.json(path)


def csv_rows(items: DataFrame, item_tags: DataFrame, min_score: float = 0.0) -> DataFrame:
    """S13. Items with their tags as "name:0.00" in one column."""
    listed = F.array_join(F.transform("tags", lambda x: F.format_string("%s:%.2f", x["name"], x["score"])), ",")
    return export_rows(items, item_tags, min_score).select("item_id", "path", listed.alias("tags"))


def export_csv(items: DataFrame, item_tags: DataFrame, path: str, min_score: float = 0.0) -> None:
    """S13. A CSV file with a header per partition."""
    csv_rows(items, item_tags, min_score).write.csv(path, header=True)


def tsv_lines(found: DataFrame) -> DataFrame:
    """S14. Search hits as tab-separated lines: id, score, path."""
    return found.select(F.format_string("%d\t%.3f\t%s", F.col("item_id").cast("long"), F.col("mean_score"), F.col("path")).alias("value"))


def report_dataset(members: DataFrame, clusters: DataFrame, nearest: int = 25) -> DataFrame:
    """S16. Per cluster its size, label and nearest members with thumbnail keys (members: cluster_no, path, distance)."""
    top = top_per_group(members.withColumn("thumb", F.substring(F.sha2("path", 256), 1, 16)), ["cluster_no"], ["distance", "path"], nearest)
    lists = top.groupBy("cluster_no").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "thumb"))).alias("nearest"))
    sizes = members.groupBy("cluster_no").agg(F.count("*").alias("n"))
    return clusters.join(sizes, "cluster_no", "left").join(lists, "cluster_no", "left")


def sidecar_plan(items: DataFrame, item_tags: DataFrame, people: DataFrame, categories: DataFrame, threshold: float = 0.5) -> DataFrame:
    """S17. Per item the subjects (tags and confirmed people) and the hierarchical ones (category|subject), sorted and distinct.

    ``people``: item_id, name; ``categories``: item_id, categories.
    """
    subjects = item_tags.where(F.col("score") >= threshold).select("item_id", F.col("tag").alias("s")).union(people.select("item_id", "name")).groupBy("item_id").agg(F.array_sort(F.collect_set("s")).alias("subjects"))
    none = F.array().cast("array<string>")
    joined = items.select("item_id", "path").join(subjects, "item_id", "left").join(categories, "item_id", "left")
    joined = joined.withColumn("subjects", F.coalesce("subjects", none)).withColumn("categories", F.coalesce("categories", none))
    pairs = F.flatten(F.transform("categories", lambda c: F.transform("subjects", lambda s: F.concat_ws("|", c, s))))
    return joined.select("item_id", "path", "subjects", F.array_sort(F.array_distinct(pairs)).alias("hierarchical"))


def sidecar_diff(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """S18. Status of each planned sidecar: skipped if it is not older than the item and names the same subjects, else written.

    ``plan`` has mtime too; ``existing``: path, sidecar_mtime, existing_subjects.
    """
    same = F.array_sort(F.array_distinct("subjects")) == F.array_sort(F.array_distinct("existing_subjects"))
    fresh = F.col("sidecar_mtime") >= F.col("mtime")
    return plan.join(existing, "path", "left").withColumn("status", F.when(F.coalesce(fresh & same, F.lit(False)), "skipped").otherwise("written"))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def sidecar_packets(plan: DataFrame) -> DataFrame:
    """S19. Path (the full file name and .xmp) and XML body of each sidecar."""
    bag = lambda name, col: F.concat(F.lit(f"<{name}><rdf:Bag>"), F.array_join(F.transform(col, lambda s: F.concat(F.lit("<rdf:li>"), _escaped(s), F.lit("</rdf:li>"))), ""), F.lit(f"</rdf:Bag></{name}>"))
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/">'
    tail = "</rdf:Description></rdf:RDF></x:xmpmeta>"
    body = F.concat(F.lit(head), bag("dc:subject", F.col("subjects")), bag("lr:hierarchicalSubject", F.col("hierarchical")), F.lit(tail))
    return plan.select(F.concat("path", F.lit(".xmp")).alias("sidecar_path"), body.alias("body"))


def sidecar_candidates(listing: DataFrame, files: DataFrame) -> DataFrame:
    """S20. Files of a listing that have a sidecar among ``files``."""
    return listing.join(files.select(F.col("path").alias("_side")), F.concat("path", F.lit(".xmp")) == F.col("_side"), "left_semi")
