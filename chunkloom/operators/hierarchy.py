"""Groups and arrays as a catalog table: path, parent, depth, node_type, meta (JSON)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArrayNotFoundError, ContainsArrayError, ContainsGroupError, GroupNotFoundError

SCHEMA = "path string, parent string, depth int, node_type string, meta string"


def normalized_path(path: str) -> str:
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    if any(p in (".", "..") for p in parts):
        raise ValueError(f"{path!r} holds . or ..")
    return "/".join(parts)


def parent_of(path: Column) -> Column:
    return F.when(path == "", F.lit(None).cast("string")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def depth_of(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/"))).cast("int")


def catalog_rows(nodes: DataFrame) -> DataFrame:
    """Catalog rows of (path, node_type, meta)."""
    p = F.col("path")
    return nodes.select("path", parent_of(p).alias("parent"), depth_of(p).alias("depth"), "node_type", "meta")


def with_implicit_groups(nodes: DataFrame) -> DataFrame:
    """The nodes and all groups that their paths imply, the root too: ancestors are exploded, never walked."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    implied = nodes.select(F.explode(above).alias("path")).distinct().join(nodes.select("path"), "path", "left_anti")
    return nodes.unionByName(implied.select("path", F.lit("group").alias("node_type"), F.lit("{}").alias("meta")))


class Catalog:
    """A hierarchy. Each change makes a new catalog; save() writes one."""

    def __init__(self, nodes: DataFrame) -> None:
        self.nodes = nodes

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(spark.createDataFrame([("", None, 0, "group", "{}")], SCHEMA))

    @classmethod
    def of(cls, nodes: DataFrame, check: bool = True) -> Catalog:
        """From (path, node_type, meta); arrays are leaves."""
        made = cls(catalog_rows(with_implicit_groups(nodes)))
        if check:
            inner = made.nodes.select(F.col("parent").alias("path"))
            if not made.nodes.filter("node_type = 'array'").join(inner, "path", "left_semi").isEmpty():
                raise ContainsArrayError("an array can't hold other nodes")
        return made

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(spark.read.schema(SCHEMA).parquet(path))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)

    # -- looking up

    def node(self, path: str) -> dict[str, Any] | None:
        row = self.nodes.filter(F.col("path") == normalized_path(path)).first()
        return None if row is None else row.asDict() | {"meta": json.loads(row["meta"])}

    def array(self, path: str) -> dict[str, Any]:
        found = self.node(path)
        if found is None or found["node_type"] != "array":
            raise ArrayNotFoundError(path)
        return found

    def group(self, path: str) -> dict[str, Any]:
        found = self.node(path)
        if found is None or found["node_type"] != "group":
            raise GroupNotFoundError(path)
        return found

    def __contains__(self, path: str) -> bool:
        return self.node(path) is not None

    def members(self, path: str = "", max_depth: int | None = 0, node_type: str | None = None) -> DataFrame:
        """Nodes below a path; max_depth 0 is children, None all."""
        path = normalized_path(path)
        base = 0 if path == "" else path.count("/") + 1
        inside = F.col("path") != "" if path == "" else F.col("path").startswith(path + "/")
        df = self.nodes.filter(inside)
        if max_depth is not None:
            df = df.filter(F.col("depth") <= base + 1 + max_depth)
        return df.filter(F.col("node_type") == node_type) if node_type else df

    def arrays(self, path: str = "") -> DataFrame:
        return self.members(path, node_type="array")

    def groups(self, path: str = "") -> DataFrame:
        return self.members(path, node_type="group")

    def n_members(self) -> DataFrame:
        """(path, nmembers): children of every group that has any."""
        return self.nodes.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("nmembers"))

    # -- changing

    def created(self, nodes: DataFrame, overwrite: bool = False) -> Catalog:
        """With nodes (path, node_type, meta) and the groups that they imply. Nodes that exist raise, or with overwrite go with all below."""
        named = nodes.select("path").distinct()
        old = self.nodes
        if overwrite:
            # a node goes if it, or a group that it stands in, is named: equal paths meet, no pair of prefixes is tried
            parts = F.split("path", "/")
            ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
            gone = old.select("path", F.explode(ups).alias("up")).join(named.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
            old = old.join(gone, "path", "left_anti")
        else:
            clash = old.join(named, "path", "left_semi").first()
            if clash is not None:
                raise (ContainsArrayError if clash["node_type"] == "array" else ContainsGroupError)(clash["path"])
        new = with_implicit_groups(nodes)
        return Catalog(old.unionByName(catalog_rows(new).join(old.select("path"), "path", "left_anti")))

    def require_group(self, path: str) -> Catalog:
        path = normalized_path(path)
        found = self.node(path)
        if found is not None:
            if found["node_type"] == "array":
                raise ContainsArrayError(path)
            return self
        return self.created(self.nodes.sparkSession.createDataFrame([(path, "group", "{}")], "path string, node_type string, meta string"))

    def put(self, path: str, node_type: str, meta: Mapping[str, Any], overwrite: bool = False) -> Catalog:
        return self.created(self.nodes.sparkSession.createDataFrame([(normalized_path(path), node_type, json.dumps(meta))], "path string, node_type string, meta string"), overwrite)

    def deleted(self, path: str) -> Catalog:
        path = normalized_path(path)
        if path not in self:
            raise KeyError(path)
        return Catalog(self.nodes.filter((F.col("path") != path) & ~F.col("path").startswith(path + "/")))

    def with_attributes(self, path: str, new: Mapping[str, Any], replace: bool = False) -> Catalog:
        """Attributes merged into, or put in place of, those of a node."""
        found = self.node(path)
        if found is None:
            raise KeyError(path)
        meta = found["meta"]
        meta["attributes"] = dict(new) if replace else {**meta.get("attributes", {}), **new}
        return Catalog(self.nodes.withColumn("meta", F.when(F.col("path") == normalized_path(path), F.lit(json.dumps(meta))).otherwise(F.col("meta"))))

    # -- views of all

    def consolidated(self, path: str = "") -> DataFrame:
        """One row: the documents of everything below a path, as one map."""
        df = self.members(path, None)
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "meta")))).alias("metadata"))

    def tree(self, path: str = "", level: int | None = None, max_nodes: int = 500) -> str:
        """The hierarchy as indented text, of so many nodes at most."""
        rows = self.members(path, None if level is None else level - 1).orderBy("path").limit(max_nodes + 1).collect()
        base = 0 if normalized_path(path) == "" else normalized_path(path).count("/") + 1
        lines = ["/" + normalized_path(path)]
        for r in rows[:max_nodes]:
            meta = json.loads(r["meta"])
            label = f" ({', '.join(map(str, meta.get('shape', ())))}) {meta.get('data_type', '')}".rstrip() if r["node_type"] == "array" else ""
            lines.append("  " * (r["depth"] - base) + r["path"].rsplit("/", 1)[-1] + label)
        return "\n".join(lines + ["..."] * (len(rows) > max_nodes))
