"""Facts of all files -> nodes and edges.

Each file is read on its own, in Arrow batches; what its names mean is found by
joins on (file, name) and (class, member), so that no task needs more than one
file. Chains of re-exports and of base classes are followed in rounds, as many as
the longest chain has links. Types are known where they are written (annotations,
``new`` expressions); what would need inference beyond that has no edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.extract.facts import facts
from weftline.extract.project import project_files
from weftline.plans.model import EDGE_COLUMNS, NODE_COLUMNS, Graph
from weftline.plans.settle import numbered, stored

_FACTS = (
    "file string, fact string, seq bigint, id string, kind string, name string, parent string, start_line bigint, end_line bigint, exported boolean, metadata string, syntax string, "
    "local string, publish string, type string, function boolean, how string, a string, b string, c string"
)
#: Facts of a batch, from as many files as have them; a file's own stay together.
_ROWS = 5_000
#: Rounds that chains of re-exports or base classes are followed for.
_LONGEST_CHAIN = 32
_CALLABLE = ("FunctionDeclaration", "MethodDeclaration", "MethodSignature", "VariableDeclaration")
_TYPES = ("ClassDeclaration", "InterfaceDeclaration", "TypeAliasDeclaration", "EnumDeclaration")
_VALUES = ("VariableDeclaration", "FunctionDeclaration", "ClassDeclaration", "EnumDeclaration")


def read_facts(files: DataFrame) -> DataFrame:
    """Facts of ``files`` (path, text), one row each. A table of short texts is few
    splits of few bytes, but as much work as any: files are spread by number."""

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _FACTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.extend(r | {"file": path} for r in facts(path, text or ""))
                if len(found) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.select("path", "text").where("path IS NOT NULL").repartition(parts, "path").mapInArrow(run, _FACTS)


def _resolved_path(base: Column, spec: Column) -> Column:
    """``spec`` as a path relative to the root, without ``.`` and ``..`` steps; null for
    one that leads above the root."""
    whole = F.concat_ws("/", F.nullif(F.regexp_replace(base, r"/?[^/]*$", ""), F.lit("")), spec)
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def _targets(specs: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, a, target): the project's file that each relative specifier means."""
    relative = specs.where(F.col("a").startswith("./") | F.col("a").startswith("../") | F.col("a").isin(".", "..")).select("file", "a").distinct()
    path = _resolved_path(F.col("file"), F.col("a"))
    bare = F.regexp_replace("p", r"\.[mc]?jsx?$", "")
    ways = F.array(F.col("p"), F.concat("p", F.lit(".ts")), F.concat("p", F.lit(".tsx")), F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")), F.concat("p", F.lit("/index.ts")), F.concat("p", F.lit("/index.tsx")))
    tried = relative.withColumn("p", path).select("file", "a", F.posexplode(ways).alias("at", "target"))
    # an empty folder name is the root's own index
    tried = tried.withColumn("target", F.regexp_replace("target", "^/", ""))
    hit = tried.join(paths.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return hit.groupBy("file", "a").agg(F.min_by("target", "at").alias("target"))


def _first(df: DataFrame, keys: list[str], value: str = "decl", order: str = "seq") -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


class Names:
    """What names mean: ``own`` and ``bound`` (file, name, decl), ``spaces`` (file, name,
    target) of namespace imports, ``public`` (file, name, decl), ``members`` (owner, name,
    decl), ``bases`` (id, base, seq), ``decls`` (decl, syntax, type, function, file)."""

    def __init__(self, found: DataFrame, targets: DataFrame) -> None:
        nodes = found.where("fact = 'node'")
        self.decls = stored(nodes.where("syntax IS NOT NULL").groupBy(F.col("id").alias("decl")).agg(F.first("syntax").alias("syntax"), F.first("type").alias("type"), F.max("function").alias("function"), F.first("file").alias("file")))
        self.own = stored(_first(nodes.where("local IS NOT NULL").select("file", F.col("local").alias("name"), F.col("id").alias("decl"), "seq"), ["file", "name"]))
        binds = found.where("fact = 'bind'").join(targets, ["file", "a"]).select("file", F.col("local").alias("name"), "target", F.col("b").alias("wanted"))
        again = found.where("fact = 'reexport'").join(targets, ["file", "a"]).select("file", "name", "target", F.col("b").alias("wanted"))
        self.spaces = stored(binds.where("wanted = '*'").select("file", "name", "target"))
        listed = found.where("fact = 'publish'").select("file", "name", "local")
        direct = nodes.where("publish IS NOT NULL").select("file", F.col("publish").alias("name"), F.col("id").alias("decl"), "seq")
        from_list = listed.join(self.own.select("file", F.col("name").alias("local"), "decl"), ["file", "local"]).select("file", "name", "decl", F.lit(0).cast("bigint").alias("seq"))
        public = stored(_first(direct.unionByName(from_list), ["file", "name"]))
        # links: what a file publishes of another; a star's own names stay as they are
        named = again.where("wanted <> '*'").unionByName(listed.join(binds.where("wanted <> '*'").withColumnRenamed("name", "local"), ["file", "local"]).select("file", "name", "target", "wanted"))
        stars = again.where("wanted = '*' AND name = '*'").select("file", "target")
        named, stars = stored(named), stored(stars)
        size = public.count()
        for _ in range(_LONGEST_CHAIN):
            there = public.select(F.col("file").alias("target"), F.col("name").alias("wanted"), "decl")
            more = named.join(there, ["target", "wanted"]).select("file", "name", "decl")
            wild = stars.join(there.where("wanted <> 'default'"), "target").select("file", F.col("wanted").alias("name"), "decl")
            more = more.withColumn("rank", F.lit(1)).unionByName(wild.withColumn("rank", F.lit(2)))
            public = stored(public.withColumn("rank", F.lit(0)).unionByName(more).groupBy("file", "name").agg(F.min(F.struct("rank", "decl")).alias("m")).select("file", "name", "m.decl"))
            if (now := public.count()) == size:
                break
            size = now
        self.public = public
        imported = binds.where("wanted <> '*'").join(public.select(F.col("file").alias("target"), F.col("name").alias("wanted"), "decl"), ["target", "wanted"]).select("file", "name", "decl")
        both = self.own.withColumn("rank", F.lit(0)).unionByName(imported.withColumn("rank", F.lit(1)))
        self.bound = stored(both.groupBy("file", "name").agg(F.min(F.struct("rank", "decl")).alias("m")).select("file", "name", "m.decl"))
        self.members = stored(_first(found.where("fact = 'member'").select(F.col("a").alias("owner"), "name", F.col("id").alias("decl"), "seq"), ["owner", "name"]))
        self.properties = stored(_first(found.where("fact = 'property'").select(F.col("id").alias("owner"), "name", "type", "seq"), ["owner", "name"], "type"))
        heritage = found.where("fact = 'heritage'").select("file", F.col("id").alias("child"), "kind", "how", "a", "b", "seq")
        self.heritage = stored(self.mean(heritage).select("file", "child", "kind", F.col("decl").alias("base"), "seq"))
        of_class = self.heritage.where("kind = 'EXTENDS'")
        self.bases = stored(_first(of_class, ["child"], "base"))

    def by_name(self, df: DataFrame, name: str = "a", out: str = "decl") -> DataFrame:
        return df.join(self.bound.select("file", F.col("name").alias(name), F.col("decl").alias(out)), ["file", name])

    def through_space(self, df: DataFrame, name: str = "a", member: str = "b") -> DataFrame:
        """``decl`` of a namespace import's member."""
        spaces = self.spaces.select("file", F.col("name").alias(name), "target")
        return df.join(spaces, ["file", name]).join(self.public.select(F.col("file").alias("target"), F.col("name").alias(member), "decl"), ["target", member]).drop("target")

    def mean(self, df: DataFrame) -> DataFrame:
        """``decl`` of names and of namespace members."""
        return self.by_name(df.where("how = 'name'")).unionByName(self.through_space(df.where("how = 'member'")), allowMissingColumns=True)

    def type_of(self, df: DataFrame, decl: str = "on") -> DataFrame:
        """``owner``: the class or interface that the type of variable ``decl`` names."""
        typed = self.decls.where("type IS NOT NULL").select(F.col("decl").alias(decl), F.col("type"), F.col("file").alias("type_file"))
        names = self.bound.select(F.col("file").alias("type_file"), F.col("name").alias("type"), F.col("decl").alias("owner"))
        return df.join(typed, decl).join(names, ["type_file", "type"]).drop("type", "type_file")

    def member_of(self, df: DataFrame, member: str) -> DataFrame:
        """``decl``: the ``member`` of class ``owner``, or of its nearest base that has it."""
        keep = [c for c in df.columns if c != "owner"]
        pending, done = stored(df), None
        members = self.members.select("owner", F.col("name").alias(member), "decl")
        for _ in range(_LONGEST_CHAIN):
            hit = pending.join(members, ["owner", member]).select(*keep, "decl")
            done = hit if done is None else done.unionByName(hit)
            missed = pending.join(members, ["owner", member], "left_anti")
            pending = stored(missed.withColumnRenamed("owner", "child").join(self.bases, "child").select(*keep, F.col("base").alias("owner")))
            if pending.isEmpty():
                break
        return done

    def property_of(self, df: DataFrame, name: str) -> DataFrame:
        """``owner``: the class that the type of the property ``name`` of ``owner`` names."""
        files = self.decls.select(F.col("decl").alias("owner"), F.col("file").alias("type_file"))
        typed = self.properties.select("owner", F.col("name").alias(name), "type").join(files, "owner")
        names = self.bound.select(F.col("file").alias("type_file"), F.col("name").alias("type"), F.col("decl").alias("next"))
        return df.join(typed, ["owner", name]).join(names, ["type_file", "type"]).drop("owner", "type", "type_file").withColumnRenamed("next", "owner")

    def targets(self, uses: DataFrame) -> DataFrame:
        """``uses`` (file, how, a, b, c, ...) with ``decl``, the declaration that each
        means; those that mean none have no row."""
        cols = [*uses.columns, "decl"]
        part = lambda *how: uses.where(F.col("how").isin(*how))
        plain = self.mean(part("name", "member"))
        # a member of a class, or of a variable whose type is known
        on = self.by_name(part("member"), out="on")
        klass = on.join(self.decls.where(F.col("syntax").isin("ClassDeclaration", "InterfaceDeclaration")).select(F.col("decl").alias("on")), "on", "left_semi").withColumn("owner", F.col("on"))
        owned = klass.drop("on").unionByName(self.type_of(on).drop("on"))
        owned = owned.unionByName(self.by_name(part("typed"), out="owner"))
        owned = owned.unionByName(part("class").withColumn("owner", F.col("a")))
        owned = owned.unionByName(part("super").withColumn("child", F.col("a")).join(self.bases, "child").withColumn("owner", F.col("base")).drop("child", "base"))
        simple = self.member_of(owned.select(*uses.columns, "owner"), "b")
        # a member of a typed property, or of a class of a namespace
        far = self.property_of(part("prop").withColumn("owner", F.col("a")), "b").unionByName(self.property_of(self.by_name(part("typedprop"), out="owner"), "b"))
        deep_on = self.by_name(part("deep"), out="on")
        deep = self.property_of(self.type_of(deep_on).drop("on"), "b").unionByName(self.through_space(part("deep")).withColumnRenamed("decl", "owner"))
        distant = self.member_of(far.unionByName(deep).select(*uses.columns, "owner"), "c")
        return plain.select(*cols).unionByName(simple.select(*cols)).unionByName(distant.select(*cols))


def _edges(df: DataFrame, kind: Column | str, src: str, dst: str, phase: int) -> DataFrame:
    """Raw edges; ``seq`` orders them by phase only, as the metadata of one edge are
    all alike."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("kind"), F.lit(None).cast("string").alias("specifier"), F.lit(phase).alias("phase"), "file", "seq")


def _routes(found: DataFrame) -> DataFrame:
    return found.where("fact = 'endpoint'").select("file", "seq", "id", "name", "how", "a", "b", "c", "start_line", "end_line", "exported", "metadata")


def raw_graph(files: DataFrame, semantic: bool = False, links: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(nodes, edges) before repeats are folded, for ``files`` (path, text). Without
    ``links`` there are no edges, and what names mean is found for routes alone, if
    there are any."""
    files = stored(project_files(files).select("path", "text"))
    found = stored(read_facts(files))
    targets = stored(_targets(found.where("fact IN ('import', 'bind', 'reexport')"), files))
    node = lambda df, ident, kind, name, path, phase: df.select(ident.alias("id"), kind.alias("kind"), name.alias("name"), path.alias("file_path"), F.coalesce("exported", F.lit(False)).alias("exported"), F.coalesce("start_line", F.lit(0)).cast("bigint").alias("start_line"), F.coalesce("end_line", F.lit(0)).cast("bigint").alias("end_line"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.lit(phase).alias("phase"), "file", "seq")
    own = found.where("fact = 'node'")
    imports = found.where("fact = 'import'").join(targets, ["file", "a"], "left")
    flags, apis = found.where("fact = 'flag'"), found.where("fact = 'api'")
    nodes = node(own, F.col("id"), F.col("kind"), F.col("name"), F.col("file"), 0)
    nodes = nodes.unionByName(node(imports.where("target IS NULL"), F.concat(F.lit("External:"), F.col("a")), F.lit("ExternalModule"), F.col("a"), F.col("a"), 0))
    nodes = nodes.unionByName(node(flags, F.concat(F.lit("Config:"), F.col("name")), F.lit("ConfigFlag"), F.col("name"), F.lit("process.env"), 0))
    nodes = nodes.unionByName(node(apis, F.concat(F.lit("Api:"), F.col("name")), F.lit("ExternalAPI"), F.col("name"), F.col("name"), 0))
    if not links and (not semantic or _routes(found).isEmpty()):
        return nodes, None
    edges = imports.select(F.concat(F.lit("Module:"), F.col("file")).alias("src"), F.coalesce(F.concat(F.lit("Module:"), F.col("target")), F.concat(F.lit("External:"), F.col("a"))).alias("dst"), F.lit("IMPORTS").alias("kind"), F.col("a").alias("specifier"), F.lit(0).alias("phase"), "file", "seq")
    edges = edges.unionByName(_edges(own.where("parent IS NOT NULL"), "CONTAINS", "parent", "id", 0))
    edges = edges.unionByName(_edges(own.where("exported").withColumn("module", F.concat(F.lit("Module:"), F.col("file"))), "EXPORTS", "module", "id", 0))
    edges = edges.unionByName(_edges(flags.withColumn("flag", F.concat(F.lit("Config:"), F.col("name"))), "READS_CONFIG", "id", "flag", 0))
    edges = edges.unionByName(_edges(apis.withColumn("api", F.concat(F.lit("Api:"), F.col("name"))), "CALLS_EXTERNAL", "id", "api", 0))
    if not semantic:
        return nodes, edges
    names = Names(found, targets)
    kinds = names.decls.select("decl", "syntax", F.col("function").alias("is_function"))
    if links:
        uses = found.where("fact = 'use'").select("file", "seq", "id", "kind", "how", "a", "b", "c")
        meant = names.targets(uses).join(kinds, "decl")
        right = (
            ((F.col("kind") == "CALLS") & F.col("syntax").isin(*_CALLABLE)) | ((F.col("kind") == "INSTANTIATES") & (F.col("syntax") == "ClassDeclaration"))
            | (F.col("kind").isin("READS", "WRITES") & F.col("syntax").isin(*_VALUES) & (F.col("id") != F.col("decl"))) | (F.col("kind").isin("USES_TYPE", "RETURNS", "PARAM_TYPE") & F.col("syntax").isin(*_TYPES))
        )
        edges = edges.unionByName(_edges(meant.where(right), F.col("kind"), "id", "decl", 1))
        heritage = names.heritage.join(kinds, names.heritage["base"] == kinds["decl"]).where(F.col("syntax").isin("ClassDeclaration", "InterfaceDeclaration", "TypeAliasDeclaration"))
        edges = edges.unionByName(_edges(heritage, F.col("kind"), "child", "base", 1))
        edges = edges.unionByName(_edges(_overrides(names, found), "OVERRIDES", "id", "decl", 1))
    routes = _routes(found)
    handled = names.targets(routes).join(kinds, "decl").where(F.col("syntax").isin("FunctionDeclaration", "MethodDeclaration") | ((F.col("syntax") == "VariableDeclaration") & F.col("is_function")))
    nodes = nodes.unionByName(node(routes.where("how = 'inline'").unionByName(handled.select(*routes.columns)), F.col("id"), F.lit("Endpoint"), F.col("name"), F.col("file"), 1))
    return nodes, edges.unionByName(_edges(handled, "HANDLES", "id", "decl", 1)) if links else None


def _overrides(names: Names, found: DataFrame) -> DataFrame:
    """(file, seq, id, decl): methods of classes with the nearest base's method of the
    same name, and with each implemented interface's."""
    methods = found.where("fact = 'member' AND a LIKE 'ClassDeclaration:%'").select("file", "seq", "id", F.col("a").alias("child"), "name")
    above = names.member_of(methods.join(names.bases, "child").select("file", "seq", "id", "name", F.col("base").alias("owner")), "name")
    shapes = names.heritage.where("kind = 'IMPLEMENTS' AND base LIKE 'InterfaceDeclaration:%'").select("child", F.col("base").alias("owner"))
    shaped = methods.join(shapes, "child").join(names.members, ["owner", "name"])
    return above.select("file", "seq", "id", "decl").unionByName(shaped.select("file", "seq", "id", "decl"))


def build(files: DataFrame, semantic: bool = False) -> Graph:
    """The graph of ``files`` (path, text). Of nodes that repeat an id the last one in
    order of the files counts; edges that repeat are folded, with their number as
    ``count`` and the first one's metadata. ``semantic`` adds what needs the meaning of
    names: heritage, types, calls, instances, reads and writes, routes. Null texts are
    empty files; files that aren't TypeScript sources, declaration files and installed
    packages are left out; no files make an empty graph."""
    nodes, edges = raw_graph(files, semantic)
    return Graph.of(_folded(nodes), _counted(edges))


def build_nodes(files: DataFrame, semantic: bool = False) -> DataFrame:
    """The nodes of ``build``, without the work that only edges need."""
    return _folded(raw_graph(files, semantic, links=False)[0])


def build_edges(files: DataFrame, semantic: bool = False) -> DataFrame:
    """The edges of ``build``, without putting the nodes in order."""
    return _counted(raw_graph(files, semantic)[1])


def _folded(nodes: DataFrame) -> DataFrame:
    columns = ["kind", "name", "file_path", "exported", "start_line", "end_line", "metadata"]
    place = F.struct("phase", "file", "seq")
    folded = nodes.groupBy("id").agg(F.max_by(F.struct(*columns), place).alias("s"), F.max(place).alias("at"))
    return _numbered(folded.select(F.xxhash64("id").alias("seq"), "id", "s.*", "at")).select(*NODE_COLUMNS)


def _counted(edges: DataFrame) -> DataFrame:
    place = F.struct("phase", "file", "seq")
    counted = edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("count"), F.min_by(F.struct("specifier"), place).alias("m"), F.min(place).alias("at"))
    metadata = F.to_json(F.struct(F.col("m.specifier").alias("specifier"), "count"))
    return _numbered(counted.select("src", "dst", "kind", metadata.alias("metadata"), "at")).select(*EDGE_COLUMNS)


def _numbered(df: DataFrame) -> DataFrame:
    """``seq`` in the order of ``at``."""
    order = [F.col(c) for c in ("at", "id", "src", "dst", "kind") if c in df.columns]
    return numbered(df.drop("seq"), *order, name="seq").drop("at")
