"""Which function a call means: lookups as joins, and the part of their results that a tree asks for."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modules that a ``use`` of a web module brings in besides the used one.
WEB = ["Phoenix.Component"]


def functions_of(clauses: DataFrame) -> DataFrame:
    """``(module, name, arity, ord, n_clauses, n_heex)``: one row for each function, numbered in the order of the sources."""
    return clauses.groupBy("module", "name", "arity").agg(
        F.min(F.struct("source_file", "pos")).alias("ord"),
        F.count(F.lit(1)).alias("n_clauses"),
        F.count("heex").alias("n_heex"),
    )


def _best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.min_by(F.struct("module", "name", "arity"), "rank").alias("f")).select(*keys, "f.module", "f.arity")


def local_lookup(calls: DataFrame, modules: DataFrame, functions: DataFrame) -> DataFrame:
    """``(caller, name, module, arity)`` for ``calls(caller, name)``: own module, imports, uses and what they imply, anywhere.

    Within a module the function of one argument is preferred; of functions anywhere the last of the
    sources is taken. Calls without a function are left out.
    """
    calls = calls.select("caller", "name").distinct()
    own = calls.select("caller").distinct().select("caller", F.col("caller").alias("module"), F.lit(0).alias("prio"), F.lit(0).alias("at"), F.lit(0).alias("sub"))
    known = modules.select(F.col("module").alias("caller"), "imports", "uses")
    imports = known.select("caller", F.posexplode("imports").alias("at", "module")).select("caller", "module", F.lit(1).alias("prio"), "at", F.lit(0).alias("sub"))
    brought = F.when(F.col("used") == "Phoenix.Component", F.array(F.lit("Phoenix.Component"))).when(F.col("used") == "Phoenix.LiveView", F.array(F.lit("Phoenix.Component"), F.lit("Phoenix.LiveView"))).when(F.col("used").endswith("Web"), F.array(*[F.lit(w) for w in WEB])).otherwise(F.array().cast("array<string>"))
    uses = known.select("caller", F.posexplode("uses").alias("at", "used")).select("caller", "at", F.posexplode(F.concat(F.array("used"), brought)).alias("sub", "module")).select("caller", "module", F.lit(2).alias("prio"), "at", "sub")
    near = own.unionByName(imports).unionByName(uses)
    rank = F.struct("prio", "at", "sub", (F.col("arity") != 1).alias("other"), "ord")
    found = calls.join(near, "caller").join(functions, ["module", "name"]).select("caller", "name", "module", "arity", rank.alias("rank"))
    best = _best(found, ["caller", "name"])
    anywhere = functions.groupBy("name").agg(F.max_by(F.struct("module", "arity"), "ord").alias("f")).select("name", "f.module", "f.arity")
    rest = calls.join(best.select("caller", "name"), ["caller", "name"], "left_anti").join(anywhere, "name").select("caller", "name", "module", "arity")
    return best.unionByName(rest)


def remote_lookup(calls: DataFrame, modules: DataFrame, functions: DataFrame) -> DataFrame:
    """``(caller, target, name, module, arity)`` for ``calls(caller, target, name)``: by alias, by name, by the end of a module's name."""
    calls = calls.select("caller", "target", "name").distinct()
    aliases = modules.select(F.col("module").alias("caller"), F.explode("aliases").alias("target", "full"))
    named = calls.join(aliases, ["caller", "target"], "left")
    own = F.struct((F.col("arity") != 1).alias("other"), "ord")
    n = F.size(F.split("module", r"\."))
    ends = functions.select("name", "module", "arity", own.alias("own"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(F.split("module", r"\."), -k, k), "."))).alias("target"))
    ends = ends.groupBy("target", "name").agg(F.min_by(F.struct("module", "arity", "own"), F.struct("module", "own")).alias("f"))  # one for each end, however many modules have it
    ways = [
        named.where("full IS NOT NULL").select("caller", "target", "name", F.col("full").alias("module"), F.lit(0).alias("prio")),
        calls.select("caller", "target", "name", F.col("target").alias("module"), F.lit(1).alias("prio")),
    ]
    found = ways[0].unionByName(ways[1]).join(functions, ["module", "name"]).select("caller", "target", "name", "module", "arity", F.struct("prio", "module", own.alias("own")).alias("rank"))
    last = calls.join(ends, ["target", "name"]).select("caller", "target", "name", "f.module", "f.arity", F.struct(F.lit(2).alias("prio"), "f.module", "f.own").alias("rank"))
    return _best(found.unionByName(last), ["caller", "target", "name"])


def lookups(calls: DataFrame, modules: DataFrame, functions: DataFrame) -> DataFrame:
    """``(caller, target, name, module, arity)`` for ``calls(caller, target, name)``, local where the target is null; of a module that is defined twice the last counts."""
    told = F.struct("module", "source_file", "imports", "uses", "aliases")
    modules = modules.where("module IS NOT NULL").groupBy("module").agg(F.max_by(told, F.struct("source_file", "pos")).alias("m")).select("m.*")
    near = local_lookup(calls.where("target IS NULL").select("caller", "name"), modules, functions)
    far = remote_lookup(calls.where("target IS NOT NULL"), modules, functions)
    return near.select("caller", F.lit(None).cast("string").alias("target"), "name", "module", "arity").unionByName(far.select("caller", "target", "name", "module", "arity"))


def is_raw(target: list[str] | None, name: str) -> bool:
    """Whether a call is that of ``raw`` itself."""
    return name == "raw" and (target is None or target[-1] == "HTML")


class Asked:
    """Stands for a registry, to tell what a tree asks of it: every function is there and has no clauses."""

    def __init__(self):
        self.calls: dict[tuple[str | None, str], None] = {}
        self.clauses: dict[tuple, list[dict]] = defaultdict(list)

    def local(self, caller: str | None, name: str) -> tuple[str, int]:
        return self.remote(caller, None, name)

    def remote(self, caller: str | None, target: str | None, name: str) -> tuple[str, int]:
        self.calls[target, name] = None
        return "", 0

    def find(self, caller: str | None, target: list[str] | None, name: str) -> tuple[str, int]:
        return self.remote(caller, ".".join(target) if target is not None else None, name)


class Told:
    """The part of the registry that one tree asks for: its calls, and each function it comes to with the calls that function makes."""

    def __init__(self, caller: str | None, calls: list[dict], functions: list[dict]):
        self.calls = {(caller, c.get("target"), c["name"]): (c["module"], c["arity"]) for c in calls}
        self.clauses: dict[tuple, list[dict]] = {}
        for f in functions:
            self.calls |= {(f["module"], c.get("target"), c["name"]): (c["module"], c["arity"]) for c in f["calls"]}
            tail = '[[null, "raw"]]' if f["raw"] else "[]"
            self.clauses[f["module"], f["name"], f["arity"]] = [{"heex": "" if i < f["n_heex"] else None, "returns": r.get("returns"), "tail": tail} for i, r in enumerate(f["told"])]

    def local(self, caller: str | None, name: str) -> tuple[str, int] | None:
        return self.calls.get((caller, None, name))

    def remote(self, caller: str | None, target: str, name: str) -> tuple[str, int] | None:
        return self.calls.get((caller, target, name))

    def find(self, caller: str | None, target: list[str] | None, name: str) -> tuple[str, int] | None:
        return self.calls.get((caller, ".".join(target) if target is not None else None, name))
