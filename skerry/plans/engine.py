"""Typed tables with recipes: check, run, reuse, replay, compare.

Artifacts are folders of Parquet tables under one root; a catalog of artifacts and an append-only log of steps are Parquet
tables too. An operator declares its slots and parameters; its function maps DataFrames to DataFrames.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators.constraints import Field, problems

_ARTIFACTS = "id string, type string, module string, version string, params string, inputs map<string,string>, tables map<string,bigint>, metrics map<string,double>, created_at double"
_STEPS = "run_id string, step_index int, module string, params string, inputs map<string,string>, outputs map<string,string>, status string, cached boolean, error string, replay_of int, duration_s double, saved_at double, step_key string"


@dataclass(frozen=True)
class Param:
    kind: str  # integer, number, string, boolean
    default: Any
    least: float | None = None
    most: float | None = None
    choices: tuple = ()

    def accept(self, name: str, v: Any) -> Any:
        if self.kind == "boolean":
            if not isinstance(v, bool):
                raise ValueError(f"{name}: a boolean is wanted, not {v!r}")
        elif self.kind in ("integer", "number"):
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise ValueError(f"{name}: a number is wanted, not {v!r}")
            if float(v).is_integer():
                v = int(v)
            elif self.kind == "integer":
                raise ValueError(f"{name}: a whole number is wanted, not {v!r}")
            if (self.least is not None and v < self.least) or (self.most is not None and v > self.most):
                raise ValueError(f"{name}: {v} is outside [{self.least}, {self.most}]")
        elif not isinstance(v, str):
            raise ValueError(f"{name}: text is wanted, not {v!r}")
        if self.choices and v not in self.choices:
            raise ValueError(f"{name}: {v!r} is none of {self.choices}")
        return v


@dataclass(frozen=True)
class TypeSpec:
    """A payload type: its tables, their columns and value rules."""

    name: str
    tables: dict[str, Sequence[Field]]
    rules: dict[str, Sequence] = field(default_factory=dict)


@dataclass(frozen=True)
class Operator:
    name: str
    version: str
    consumes: dict[str, str]
    produces: dict[str, str]
    run: Callable[[dict[str, dict[str, DataFrame]], dict[str, Any]], dict[str, dict[str, DataFrame]]]
    params: dict[str, Param] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    kind: str = "transform"


def recipe_id(op: Operator, params: dict[str, Any], inputs: dict[str, str], slot: str, types: dict[str, str]) -> str:
    """Content of the work, not of its result: equal module, version, full parameters and inputs give the same id.

    Inputs are sorted, so their order is no part of it; slots of one type are told apart by name.
    """
    kinds = list(types.values())
    ins = sorted(i if kinds.count(types[s]) == 1 else f"{s}={i}" for s, i in inputs.items())
    text = json.dumps({"module": op.name, "version": op.version, "params": params, "inputs": ins, "slot": slot}, sort_keys=True, separators=(",", ":"))
    return "art_" + hashlib.sha256(text.encode()).hexdigest()[:12]


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.types: dict[str, TypeSpec] = {}
        self.ops: dict[str, Operator] = {}

    # registry
    def add_type(self, t: TypeSpec) -> None:
        if t.name in self.types:
            raise ValueError(f"type {t.name} is registered already")
        self.types[t.name] = t

    def register(self, op: Operator) -> None:
        if op.name in self.ops:
            raise ValueError(f"operator {op.name} is registered already")
        unknown = [t for t in (*op.consumes.values(), *op.produces.values()) if t not in self.types]
        if unknown:
            raise ValueError(f"{op.name}: unknown types {unknown}")
        self.ops[op.name] = op

    def operators(self) -> DataFrame:
        rows = [(o.name, o.version, o.kind, sorted(o.consumes.values()), sorted(o.produces.values())) for o in self.ops.values()]
        return self.spark.createDataFrame(rows, "name string, version string, kind string, consumes array<string>, produces array<string>")

    def find(self, kind: str | None = None, consumes: str | None = None, produces: str | None = None, not_consuming: str | None = None) -> DataFrame:
        o = self.operators()
        if kind:
            o = o.filter(F.col("kind") == kind)
        for c, v in (("consumes", consumes), ("produces", produces)):
            if v:
                o = o.filter(F.array_contains(c, v))
        return o.filter(~F.array_contains("consumes", not_consuming)) if not_consuming else o

    def successors(self, name: str) -> DataFrame:
        made = list(self.ops[name].produces.values())
        return self.operators().filter(F.arrays_overlap("consumes", F.array(*[F.lit(m) for m in made])))

    def orphans(self) -> DataFrame:
        """Types that are made and that no operator takes."""
        o = self.operators()
        made = o.select(F.explode("produces").alias("type")).distinct()
        return made.join(o.select(F.explode("consumes").alias("type")), "type", "left_anti")

    # catalog
    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def artifacts(self, type: str | None = None) -> DataFrame:
        a = self._read("artifacts", _ARTIFACTS)
        w = Window.partitionBy("id").orderBy(F.desc("created_at"))
        a = a.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        return (a.filter(F.col("type") == type) if type else a).orderBy("id")

    def steps(self, run_id: str | None = None) -> DataFrame:
        """The log, one row per run and step. Writers only append rows under keys of their own; steps are numbered on
        reading, in order of saving, so two writers never take the same number."""
        s = self._read("steps", _STEPS)
        s = s.withColumn("step_index", F.row_number().over(Window.partitionBy("run_id").orderBy("saved_at", "step_key")) - 1)
        return (s.filter(F.col("run_id") == run_id) if run_id else s).orderBy("run_id", "step_index")

    def artifact(self, id: str) -> dict[str, Any]:
        row = self.artifacts().filter(F.col("id") == id).first()
        if row is None:
            raise KeyError(id)
        return row.asDict()

    def load(self, id: str, table: str | None = None, columns: Sequence[str] | None = None) -> Any:
        """One table of an artifact (only the given columns are read), or all of them by name."""
        a = self.artifact(id)
        if table is None:
            return {t: self.spark.read.parquet(f"{self.root}/data/{id}/{t}") for t in a["tables"]}
        df = self.spark.read.parquet(f"{self.root}/data/{id}/{table}")
        return df.select(*columns) if columns else df

    # plan
    def check(self, name: str, inputs: dict[str, str], params: dict[str, Any] | None = None) -> dict[str, Any]:
        """Everything that can be known before running: all problems together, full parameters, planned ids, what is cached."""
        op, found = self.ops[name], []
        given = params or {}
        found += [f"{p}: unknown parameter" for p in given if p not in op.params]
        full = {}
        for p, spec in op.params.items():
            try:
                full[p] = spec.accept(p, given.get(p, spec.default))
            except ValueError as e:
                found.append(str(e))
        found += [f"{s}: unknown slot" for s in inputs if s not in op.consumes]
        types = {}
        for slot, want in op.consumes.items():
            if slot not in inputs:
                if slot not in op.optional:
                    found.append(f"{slot}: missing, a {want} is wanted")
                continue
            try:
                got = self.artifact(inputs[slot])["type"]
            except KeyError:
                found.append(f"{slot}: no artifact {inputs[slot]}")
                continue
            types[slot] = want
            if got != want:
                found.append(f"{slot}: is a {got}, a {want} is wanted")
        out: dict[str, Any] = {"problems": found, "params": full, "ids": {}, "cached": False}
        if not found:
            out["ids"] = {s: recipe_id(op, full, inputs, s, types) for s in op.produces}
            have = {r["id"] for r in self.artifacts().filter(F.col("id").isin(list(out["ids"].values()))).select("id").collect()}
            out["cached"] = set(out["ids"].values()) <= have
        return out

    # run
    def run(self, name: str, run_id: str, inputs: dict[str, str], params: dict[str, Any] | None = None, force: bool = False, replay_of: int | None = None) -> dict[str, str]:
        """Runs an operator, or reuses its results where the recipe has run. Either way the step is logged."""
        plan = self.check(name, inputs, params)
        if plan["problems"]:
            raise ValueError("; ".join(plan["problems"]))
        op, began, ids = self.ops[name], time.time(), plan["ids"]
        cached = plan["cached"] and not force
        error = ""
        try:
            if not cached:
                out = op.run({s: self.load(i) for s, i in inputs.items()}, plan["params"])
                for slot, tables in out.items():
                    self._seal(ids[slot], op, slot, tables, plan["params"], inputs)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:2000]
            raise
        finally:
            row = (run_id, None, name, json.dumps(plan["params"], sort_keys=True), inputs, {} if error else ids, "failed" if error else "cached" if cached else "ok", cached, error, replay_of, time.time() - began, time.time(), uuid.uuid4().hex)
            self.spark.createDataFrame([row], _STEPS).coalesce(1).write.mode("append").parquet(f"{self.root}/steps")
        return ids

    def _seal(self, id: str, op: Operator, slot: str, tables: dict[str, DataFrame], params: dict[str, Any], inputs: dict[str, str]) -> None:
        """Writes to a staging folder, checks every table there, then moves the folder into place and lists it. A failed
        check removes the staging folder."""
        spec, stage = self.types[op.produces[slot]], f"{self.root}/staging/{uuid.uuid4().hex}"
        hp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hp(stage).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            bad, rows = [f"{t}: missing" for t in spec.tables if t not in tables], {}
            for t, df in tables.items():
                df.write.parquet(f"{stage}/{t}")
                back = self.spark.read.schema(df.schema).parquet(f"{stage}/{t}")
                rows[t] = back.count()
                bad += [f"{t}.{p}" for p in problems(back, spec.tables.get(t, ()), spec.rules.get(t, ()))]
            if bad:
                raise ValueError("; ".join(bad))
            fs.mkdirs(hp(f"{self.root}/data"))
            fs.delete(hp(f"{self.root}/data/{id}"), True)
            fs.rename(hp(stage), hp(f"{self.root}/data/{id}"))
        finally:
            fs.delete(hp(stage), True)
        row = (id, op.produces[slot], op.name, op.version, json.dumps(params, sort_keys=True), inputs, rows, {f"{t}_rows": float(n) for t, n in rows.items()}, time.time())
        self.spark.createDataFrame([row], _ARTIFACTS).coalesce(1).write.mode("append").parquet(f"{self.root}/artifacts")

    # lineage
    def lineage(self, id: str) -> DataFrame:
        """``id, type, module, depth``: the artifact and all it derives from, nearest first."""
        from skerry.operators.graph import ancestry

        a = self.artifacts()
        edges = a.select("id", F.explode(F.map_values("inputs")).alias("parent"))
        up = ancestry(edges, "id", "parent", self.spark.createDataFrame([(id,)], "s string"), "s").select(F.col("ancestor").alias("id"), "depth")
        return up.unionByName(self.spark.createDataFrame([(id, 0)], "id string, depth int")).join(a.select("id", "type", "module", "params"), "id").orderBy("depth", "id")

    def diverge(self, left: str, right: str) -> DataFrame:
        from skerry.operators.graph import diverge

        key = ["module", "type"]
        side = lambda i: self.lineage(i).groupBy(*key).agg(F.min("id").alias("item"))
        return diverge(side(left), side(right), key, "item")

    def compare(self, ids: Sequence[str]) -> DataFrame:
        """Metrics side by side: a row per metric, a column per artifact."""
        m = self.artifacts().filter(F.col("id").isin(list(ids))).select("id", F.explode("metrics").alias("metric", "value"))
        return m.groupBy("metric").pivot("id", list(ids)).agg(F.first("value")).orderBy("metric")

    def replay(self, run_id: str, from_artifact: str, overrides: dict[str, Any], toward: str | None = None) -> dict[str, str]:
        """Runs the producer of an artifact again with other parameters, and after it every step of the run that depends on
        it (or only those on the way to ``toward``). Returns old id -> new id. The old branch stays; failed steps are
        skipped; the first error ends the replay."""
        log = [r.asDict() for r in self.steps(run_id).collect()]  # the steps of one run
        made = [r for r in log if from_artifact in (r["outputs"] or {}).values()]
        if not made:
            raise KeyError(from_artifact)
        first, remap, wanted = made[-1], {}, None
        if toward:
            wanted = {r["id"] for r in self.lineage(toward).select("id").collect()}
            if from_artifact not in wanted:
                raise ValueError(f"{toward} is not built from {from_artifact}")
        for r in [x for x in log if x["step_index"] >= first["step_index"]]:
            origin = r["step_index"] == first["step_index"]
            touched = any(i in remap for i in (r["inputs"] or {}).values())
            if r["status"] == "failed" or not (origin or touched):
                continue
            if wanted is not None and not wanted & set(r["outputs"].values()):
                continue
            params = json.loads(r["params"]) | (overrides if origin else {})
            new = self.run(r["module"], run_id, {s: remap.get(i, i) for s, i in r["inputs"].items()}, params, replay_of=r["step_index"])
            remap |= {old: new[s] for s, old in r["outputs"].items() if new[s] != old}
        return remap

    def leaves(self, run_id: str, ignore: Sequence[str] = ()) -> list[str]:
        """Artifacts of a run that no step takes, in order of making and as often as they were made; modules in ``ignore`` (such as
        verifications) do not count as takers."""
        s = self.steps(run_id)
        used = s.filter(~F.col("module").isin(list(ignore)) if ignore else F.lit(True)).select(F.explode(F.map_values("inputs")).alias("id")).distinct()
        out = s.filter("status <> 'failed'").select("step_index", F.explode("outputs").alias("slot", "id"))
        return [r["id"] for r in out.join(used, "id", "left_anti").orderBy("step_index", "slot").collect()]

    def wire(self, name: str, current: dict[str, str], overrides: dict[str, str] | None = None) -> dict[str, str]:
        """Inputs of an operator by type: each required slot takes the current artifact of its type, ``overrides`` come first.
        Optional slots are filled by overrides only."""
        op, given = self.ops[name], overrides or {}
        auto = {s: current[t] for s, t in op.consumes.items() if s not in op.optional and t in current}
        return auto | {s: i for s, i in given.items() if s in op.consumes}

    def describe(self, name: str) -> dict[str, Any]:
        """All that an operator declares, with its parameters as JSON Schema."""
        op = self.ops[name]
        return {
            "name": op.name, "version": op.version, "kind": op.kind, "consumes": dict(op.consumes), "produces": dict(op.produces),
            "optional": sorted(op.optional), "transform": bool(set(op.consumes.values()) & set(op.produces.values())), "params": self.param_schema(name),
        }

    def param_schema(self, name: str) -> dict[str, Any]:
        props = {}
        for p, spec in self.ops[name].params.items():
            props[p] = {"type": spec.kind, "default": spec.default} | {k: v for k, v in (("minimum", spec.least), ("maximum", spec.most), ("enum", list(spec.choices) or None)) if v is not None}
        return {"type": "object", "properties": props, "additionalProperties": False}

    def summary(self, run_id: str, verifier: str | None = None) -> dict[str, Any]:
        """Steps of a run by status, its leaves, and what the verifier's last step said of each leaf it read."""
        steps = [r.asDict() for r in self.steps(run_id).collect()]  # the steps of one run
        leaves = self.leaves(run_id, [verifier] if verifier else [])
        verdicts = {i: "unverified" for i in leaves}
        for r in steps:
            if r["module"] == verifier:
                verdicts |= {i: r["status"] for i in (r["inputs"] or {}).values() if i in verdicts}
        count = {s: sum(r["status"] == s for r in steps) for s in ("ok", "cached", "failed")}
        return {"steps": len(steps), **count, "leaves": leaves, "verdicts": verdicts}
