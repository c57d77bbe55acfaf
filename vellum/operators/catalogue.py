"""Local model files with their sizes and projectors, from a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.nearest import best_in_folders

#: A part of a split file: its number and how many there are.
SPLIT = r"-([0-9]{5})-of-([0-9]{5})\.gguf$"


def models(files: DataFrame) -> DataFrame:
    """Rows (path, name, folder, size, mmproj, vision) of the models in a listing (path, size) of resolved paths.

    Only .gguf files count, each path once (the larger size). Of a split file the first part stands for all, and its size is that of all
    parts; without the first there is no model. Files with mmproj in their names are projectors: a model takes the one of its
    folder whose name, without that word, has most in common with its own from the beginning, or else one of the folder above. A
    model with one has vision. Null paths are left out, null sizes count 0.
    """
    x = files.where(F.lower("path").endswith(".gguf")).groupBy("path").agg(F.max(F.coalesce("size", F.lit(0))).cast("long").alias("size"))
    file = F.regexp_extract("path", "[^/]*$", 0)
    x = x.withColumns({"file": file, "folder": F.regexp_replace("path", "/?[^/]*$", "")})
    x = x.withColumns({"name": F.regexp_replace("file", r"\.[^.]*$", ""), "part": F.regexp_extract("file", SPLIT, 1), "whole": F.regexp_replace("file", SPLIT, "")})
    projector = F.lower("file").contains("mmproj")
    own = x.where(~projector)
    size = own.groupBy("folder", "whole", F.regexp_extract("file", SPLIT, 2).alias("of")).agg(F.sum("size").alias("size"), F.max(F.when(F.col("part").isin("", "00001"), F.struct("path", "name"))).alias("first"))
    found = size.where("first is not null").select("first.path", "first.name", "folder", "size")
    bare = F.replace(F.replace(F.lower("name"), F.lit("mmproj-"), F.lit("")), F.lit("mmproj_"), F.lit(""))
    listed = x.where(projector).select(F.col("folder").alias("key"), bare.alias("name"), F.col("path").alias("item"))
    match = best_in_folders(found.select(F.col("path").alias("id"), "folder", F.lower("name").alias("name")), listed)
    out = found.join(match.select(F.col("id").alias("path"), F.col("item").alias("mmproj")), "path", "left")
    return out.select("path", "name", "folder", "size", "mmproj", F.col("mmproj").isNotNull().alias("vision"))
