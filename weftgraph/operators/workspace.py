"""What a workspace shows of one snapshot or of a comparison: ranges, sources, module pairs, selections, status and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import ids, scalars
from weftgraph.operators import provenance
from weftgraph.operators.matching import scoped

RANGE = ["start_line", "start_col", "end_line", "end_col", "active"]


def ranges_for_source(asked: DataFrame, modules: DataFrame, ranges: DataFrame, fallback: DataFrame) -> DataFrame:
    """Ranges of each (module, path): the module's own by normal path; the file's older ones (path, ...) only where the module
    has no ranges at all (has_ranges is false), which is not the same as having none for this file."""
    wanted = asked.join(modules.select("module", "has_ranges"), "module").withColumn("p", scalars.normal_path(F.col("path")))
    own = wanted.where("has_ranges").join(ranges.select("module", scalars.normal_path(F.col("file")).alias("p"), *RANGE), ["module", "p"])
    older = wanted.where("not has_ranges").join(fallback.select(scalars.normal_path(F.col("path")).alias("p"), *RANGE), "p")
    return own.select("module", "path", *RANGE).union(older.select("module", "path", *RANGE))


def legacy_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges stored under a source (path, file, ...): an empty file becomes the path; any other file than the path is an error."""
    wrong = F.raise_error(F.concat(F.lit("range of another file under "), "path")).cast("string")
    empty = F.coalesce(F.col("file"), F.lit("")) == ""
    return ranges.withColumn("file", F.when(empty | (F.col("file") == F.col("path")), F.col("path")).otherwise(wrong))


def attach_ranges(modules: DataFrame, ranges: DataFrame, files: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of known modules, and the modules' files (module, file_id, path) with the files of their ranges added once."""
    own = ranges.join(modules.select("module").distinct(), "module", "left_semi")
    named = own.select("module", F.col("file").alias("path")).distinct().join(sources.select("file_id", "path"), "path")
    return own, files.select("module", "file_id", "path").union(named.select("module", "file_id", "path")).distinct()


def path_relation(asked: DataFrame, inventory: DataFrame) -> DataFrame:
    """source, selected, relation: match, other, or unknown where the source may be the selected file but names none for sure.

    Equal normal paths match. Else the only inventory path that the source can stand for decides; without one, the source is
    unknown if it could stand for the selected path or shares its last component.
    """
    norm = lambda c: scalars.normal_path(F.col(c))
    pairs = asked.select("source", "selected", norm("source").alias("s"), norm("selected").alias("t")).distinct()
    paths = inventory.select(norm("path").alias("p")).distinct()
    spelled = pairs.select("s").distinct()
    longer = spelled.join(paths.select("p", F.explode(scalars.path_suffixes(F.col("p"))).alias("s")), "s")
    shorter = spelled.select("s", F.explode(scalars.path_suffixes(F.col("s"))).alias("p")).join(paths, "p", "left_semi")
    held = longer.select("s", "p").union(shorter.select("s", "p")).distinct().groupBy("s").agg(F.min("p").alias("one"), F.count("*").alias("n"))
    same = lambda a, b: (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    s, t = F.col("s"), F.col("t")
    plausible = same(s, t) | ((last(s) != "") & (last(s) == last(t)))
    relation = F.when(s == t, "match").when(F.col("n") == 1, F.when(same(F.col("one"), t), "match").otherwise("other")).when(plausible, "unknown").otherwise("other")
    return pairs.join(held, "s", "left").select("source", "selected", relation.alias("relation"))


def correlate_origins(origins: DataFrame, files: DataFrame, spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Origins (module, file, ...) with their project paths, and each module's files (module, file_id, path): its listed ones
    and those of its origins, once. What no spelling (spelling, file_id, path) resolves is dropped."""
    known = spellings.select(F.col("spelling").alias("file"), "file_id", "path")
    own = origins.join(known, "file")
    listed = files.join(known, "file").select("module", "file_id", "path")
    return own.withColumn("file", F.col("path")).select(*origins.columns), listed.union(own.select("module", "file_id", "path")).distinct()


def referenced_lines(origins: DataFrame, sources: DataFrame) -> DataFrame:
    """path, lines: the distinct start lines that origins (file, start_line) name in each source they resolve to."""
    resolved = provenance.unique_path_match(origins.select(F.col("file").alias("wanted")).distinct(), sources.select("path"))
    named = origins.join(resolved.withColumnRenamed("wanted", "file"), "file").select("path", "start_line").distinct()
    return named.groupBy("path").agg(F.array_sort(F.collect_list("start_line")).alias("lines"))


def outside_root(paths: DataFrame, root: str) -> DataFrame:
    """path, relative: the path below the root; an error for one outside of it. . and .. are resolved before."""

    def resolved(path: Column) -> Column:
        parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
        up = lambda done, p: F.when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == "..", done).otherwise(F.concat(done, F.array(p)))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))

    full = resolved(F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(f"{root}/"), "path")))
    below = F.when(full.startswith(f"{root}/"), F.substring(full, len(root) + 2, 1 << 20)).otherwise(F.raise_error(F.concat(F.lit("outside the project root: "), "path")).cast("string"))
    return paths.select("path", below.alias("relative"))


def ineffective_defines(defines: DataFrame, undefines: DataFrame) -> DataFrame:
    """name, file, line, col of explicit defines (project, name) that an undefine of the project's filelist makes void."""
    return defines.join(undefines.select("project", "name", "file", "line", "col"), ["project", "name"]).groupBy("project", "name").agg(F.min(F.struct("file", "line", "col")).alias("at")).select("project", "name", "at.*")


def checked_defines(defines: DataFrame, undefines: DataFrame) -> DataFrame:
    """The defines, with an error where one is void."""
    bad = ineffective_defines(defines, undefines).select("project", "name", "file")
    said = F.raise_error(F.concat(F.lit("a define cannot override -U of "), "name", F.lit(" in "), "file")).cast("string")
    return defines.join(bad, ["project", "name"], "left").withColumn("name", F.when(F.col("file").isNotNull(), said).otherwise(F.col("name"))).drop("file")


def project_status(projects: DataFrame, diagnostics: DataFrame, parameters: DataFrame) -> DataFrame:
    """project, status (errors if any diagnostic is one, else ready), parameters: the names of those that have a value."""
    bad = diagnostics.groupBy("project").agg(F.bool_or(F.col("severity") == "error").alias("bad"))
    given = parameters.where("value is not null").groupBy("project").agg(F.array_sort(F.collect_list("name")).alias("parameters"))
    out = projects.join(bad, "project", "left").join(given, "project", "left")
    return out.select("project", F.when(F.coalesce("bad", F.lit(False)), "errors").otherwise("ready").alias("status"), F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"))


def first_source(modules: DataFrame, origins: DataFrame, files: DataFrame, tree: DataFrame) -> DataFrame:
    """module, path: the first of the module's files (module, ord, path), then the project's (ord, path), that its first origin
    (module, ord, file) can stand for; else its first file; else the project's first file of the design languages."""
    norm = lambda c: scalars.normal_path(F.col(c))
    first = origins.groupBy("module").agg(F.min_by("file", "ord").alias("file")).join(modules.select("module"), "module", "left_semi").select("module", norm("file").alias("file"))
    p, f = norm("path"), F.col("file")
    hit = F.coalesce((p == f) | p.endswith(F.concat(F.lit("/"), f)) | f.endswith(F.concat(F.lit("/"), p)), F.lit(False))
    own = files.join(modules.select("module"), "module", "left_semi").join(first, "module", "left").select("module", F.when(hit, 0).otherwise(1).alias("rank"), F.lit(0).alias("of"), "ord", "path")
    # A project file that an origin can stand for ends like it, or the other way round: the ends are keys, with one file each.
    best = F.min(F.struct("ord", "path")).alias("best")
    longer = tree.select("ord", "path", F.explode(scalars.path_suffixes(p)).alias("file")).groupBy("file").agg(best)
    shorter = tree.select("ord", "path", p.alias("end")).groupBy("end").agg(best)
    asked = first.select("module", F.explode(scalars.path_suffixes(f)).alias("end")).join(shorter, "end").select("module", "best")
    found = first.join(longer, "file").select("module", "best").union(asked).select("module", F.lit(0).alias("rank"), F.lit(1).alias("of"), "best.ord", "best.path")
    usual = tree.where(F.rlike(F.col("path"), F.lit(r"(?i)\.(?:sv|svh|v|vh)$"))).groupBy(F.lit(1).alias("any")).agg(best)  # one row
    rest = modules.select("module", F.lit(1).alias("any")).join(usual, "any").select("module", F.lit(2).alias("rank"), F.lit(1).alias("of"), "best.ord", "best.path")
    return own.unionByName(found).unionByName(rest).groupBy("module").agg(F.min_by("path", F.struct("rank", "of", "ord")).alias("path"))


def child_pairs(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """scope, instance, ref_module, cand_module, ref_present, cand_present of paired instances (scope, instance, module)."""
    r = scoped(ref).select("scope", "instance", F.col("module").alias("ref_module"), F.lit(True).alias("r"))
    c = scoped(cand).select("scope", "instance", F.col("module").alias("cand_module"), F.lit(True).alias("c"))
    both = r.join(c, ["scope", "instance"], "full_outer")
    return both.select("scope", "instance", "ref_module", "cand_module", F.coalesce("r", F.lit(False)).alias("ref_present"), F.coalesce("c", F.lit(False)).alias("cand_present"))


def top_status(pairs: DataFrame) -> DataFrame:
    """Pairs with status: presence first, else whether name, definition and parameters of ref and cand (structs) agree."""
    equal = F.lit(True)
    for f in ("name", "definition_name"):
        equal = equal & F.col(f"ref.{f}").eqNullSafe(F.col(f"cand.{f}"))
    equal = equal & ids.same_parameters(F.col("ref.parameters_json"), F.col("cand.parameters_json"))
    one = F.when(F.col("cand").isNull(), "removed").when(F.col("ref").isNull(), "added")
    return pairs.withColumn("status", one.when(equal, "unchanged").otherwise("modified"))


def pair_key(policy: str, ref: Column, cand: Column) -> Column:
    """Key of a module pair (structs snapshot_id, module_id, definition_name, parameters_json, name): pairs of equal keys
    compare alike. Null for a missing side."""
    fields = lambda s: [s["snapshot_id"], s["module_id"], s["definition_name"], F.when(s.isNotNull(), ids.canonical_parameters(s["parameters_json"]))]
    parts = [F.lit(policy), *fields(ref), ref.isNotNull().cast("string"), *fields(cand), cand.isNotNull().cast("string"), ref["name"].eqNullSafe(cand["name"]).cast("string")]
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.array(p)), F.lit("[null]")) for p in parts])), 256)


def group_status(instances: DataFrame, children: DataFrame) -> DataFrame:
    """id, status of the group made of an expanded instance (id, ref_id, cand_id, status): one-sided, modified if the instance
    or any object of the child (id, status) is changed, else unchanged."""
    changed = children.groupBy("id").agg(F.bool_or(F.col("status") != "unchanged").alias("changed"))
    out = instances.join(changed, "id", "left")
    state = F.when(F.col("ref_id").isNull(), "added").when(F.col("cand_id").isNull(), "removed").when((F.col("status") != "unchanged") | F.coalesce("changed", F.lit(False)), "modified").otherwise("unchanged")
    return out.select("id", state.alias("status"))


def overlay_index(paired: DataFrame, side: str, kind: str = "node") -> DataFrame:
    """scope, id, overlay: ids of one side (``ref`` or ``cand``) and of the union graph, from pairs (scope, ref_id, cand_id)."""
    own = paired.where(F.col(f"{side}_id").isNotNull())
    return own.select("scope", F.col(f"{side}_id").alias("id"), ids.overlay_id(kind, F.col("ref_id"), F.col("cand_id")).alias("overlay"))


def remap_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """scope, id, source_node, target_node of a side's edges in the union graph; an error for an end that no node has."""
    out = scoped(edges).select("scope", "id", "source_node", "target_node")
    for end in ("source_node", "target_node"):
        lost = F.raise_error(F.concat(F.lit("edge "), F.col("id"), F.lit(" has an unknown end"))).cast("string")
        out = out.join(index.select("scope", F.col("id").alias(end), "overlay"), ["scope", end], "left").withColumn(end, F.coalesce("overlay", lost)).drop("overlay")
    return out.select("scope", "id", "source_node", "target_node")


def original_selection(selected: DataFrame, paired: DataFrame, preferred: str = "cand", kind: str = "node") -> DataFrame:
    """overlay, side, id: what a selected union object is on the preferred side, else on the other."""
    known = paired.select(ids.overlay_id(kind, F.col("ref_id"), F.col("cand_id")).alias("overlay"), "ref_id", "cand_id")
    other = "ref" if preferred == "cand" else "cand"
    side = F.when(F.col(f"{preferred}_id").isNotNull(), preferred).otherwise(other)
    return selected.join(known, "overlay").select("overlay", side.alias("side"), F.coalesce(f"{preferred}_id", f"{other}_id").alias("id"))


def overlay_selection(selections: DataFrame, paired: DataFrame, kind: str = "node") -> DataFrame:
    """side, id, overlay: the union objects of selections (side, id); those that are gone have none."""
    index = overlay_index(scoped(paired), "ref", kind).withColumn("side", F.lit("ref")).union(overlay_index(scoped(paired), "cand", kind).withColumn("side", F.lit("cand")))
    return selections.join(index.drop("scope"), ["side", "id"], "left").select("side", "id", "overlay")


def status_tree(inventory: DataFrame) -> DataFrame:
    """parent, name, is_file, status of the directory entries over compared sources (ref_path, cand_path, status): files carry
    their status, directories none."""
    path = scalars.normal_path(F.coalesce("cand_path", "ref_path", F.lit("")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    spread = inventory.select("status", parts.alias("p"), F.posexplode(parts).alias("i", "name"))
    last = F.col("i") == F.size("p") - 1
    return spread.select(F.array_join(F.slice("p", 1, F.col("i")), "/").alias("parent"), "name", last.alias("is_file"), F.when(last, F.col("status")).alias("status")).distinct()


def presentation(paired: DataFrame) -> DataFrame:
    """scope, overlay, field, before, after of every field that a union node's sides (structs ref and cand) don't share;
    parameters of two sides count by value."""
    names = paired.schema["ref"].dataType.names
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col("ref")[n].alias("before"), F.col("cand")[n].alias("after")) for n in names])
    spread = paired.select("scope", ids.overlay_id("node", F.col("ref_id"), F.col("cand_id")).alias("overlay"), (F.col("ref").isNotNull() & F.col("cand").isNotNull()).alias("both"), F.explode(rows).alias("x"))
    alike = F.col("both") & (F.col("x.field") == "parameters_json") & ids.same_parameters(F.col("x.before"), F.col("x.after"))
    return spread.where(~alike).select("scope", "overlay", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))
