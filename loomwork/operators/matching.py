"""Matching of inventories against catalogues, and differences between versions of a collection.

Every operator takes column names, returns a new DataFrame, and says what it does with nulls. Nothing is broadcast by
hint: a catalogue may be as large as the inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import incidence

TIERS = ("sha1", "md5", "crc", "crc_conflict", "none")


def tiered_match(files: DataFrame, catalog: DataFrame, key: str = "file_id") -> DataFrame:
    """The strongest evidence that ties each file to a catalogue entry.

    files: key, size, sha1, md5, crc; catalog: ord, entry, size, sha1, md5, crc; hashes are compared in lower case, trimmed, and null or
    empty ones match nothing. Size 0 in the catalogue matches any size. SHA-1 comes first, then MD5, then CRC, both only if SHA-1 doesn't
    contradict; last a CRC that SHA-1 contradicts. Within a tier the entry with the smallest ord wins. Entries are reduced to one for each
    set of equal hashes and size before they are joined, so copies on both sides don't multiply.
    """
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    hashes = ("sha1", "md5", "crc")
    f = files.select(F.col(key).alias("k"), F.col("size").alias("n"), *(clean(h).alias(h) for h in hashes))
    c = catalog.select("ord", "entry", F.col("size").alias("cn"), *(clean(h).alias(f"c_{h}") for h in hashes))
    c = c.groupBy("cn", *(f"c_{h}" for h in hashes)).agg(F.min(F.struct("ord", "entry")).alias("e"))
    fits = (F.col("cn") == 0) | (F.col("cn") == F.col("n"))
    conflict = F.coalesce(F.col("sha1") != F.col("c_sha1"), F.lit(False))
    found = None
    for tier, h in enumerate(hashes):
        rank = F.lit(tier) if tier < 2 else F.when(conflict, 3).otherwise(2)
        met = f.join(c, (F.col(h) == F.col(f"c_{h}")) & fits & (~conflict if tier == 1 else F.lit(True)))
        part = met.select("k", F.struct(rank.alias("tier"), F.col("e.ord").alias("ord"), F.col("e.entry").alias("entry")).alias("m"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("k").agg(F.min("m").alias("m"))
    names = F.array(*(F.lit(t) for t in TIERS))
    out = f.select("k").join(best, "k", "left")
    return out.select(F.col("k").alias(key), F.element_at(names, F.coalesce("m.tier", F.lit(4)) + 1).alias("evidence"), F.col("m.entry").alias("entry"))


def missing_entries(catalog: DataFrame, matched: DataFrame) -> DataFrame:
    """Catalogue rows (sha1, crc, ...) whose SHA-1, or CRC where they have none, no matched entry (sha1, crc) has."""
    key = lambda: F.coalesce(F.concat(F.lit("s"), F.lower("sha1")), F.concat(F.lit("c"), F.lower("crc")))
    have = matched.select(key().alias("have")).dropna().distinct()
    return catalog.withColumn("_k", key()).join(have, F.col("_k") == F.col("have"), "left_anti").drop("_k")


def drift(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256", mtime: str = "mtime") -> DataFrame:
    """key and status of every path in two snapshots: added, removed, unchanged, rot_suspected (content differs, time doesn't) or modified."""
    a = old.select(F.col(key).alias("a"), F.col(digest).alias("ah"), F.col(mtime).alias("am"))
    b = new.select(F.col(key).alias("b"), F.col(digest).alias("bh"), F.col(mtime).alias("bm"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("ah").eqNullSafe(F.col("bh")), "unchanged").when(F.col("am").eqNullSafe(F.col("bm")), "rot_suspected").otherwise("modified")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), status.alias("status"))


def baseline_diff(here: DataFrame, baseline: DataFrame, key: str = "path") -> DataFrame:
    """key and finding of paths that differ from a baseline: added_here, missing_here, size_mismatch or hash_mismatch (only where both have a hash)."""
    a = here.select(F.col(key).alias("a"), F.col("size").alias("an"), F.col("sha").alias("ah"))
    b = baseline.select(F.col(key).alias("b"), F.col("size").alias("bn"), F.col("sha").alias("bh"))
    finding = F.when(F.col("b").isNull(), "added_here").when(F.col("a").isNull(), "missing_here").when(F.col("an") != F.col("bn"), "size_mismatch").when(F.col("ah") != F.col("bh"), "hash_mismatch")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), finding.alias("finding")).filter("finding IS NOT NULL")


def move_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differences of two content indexes (ord, path, size, sha): rows of kind changed, moved, added or removed; unchanged paths aren't listed.

    Paths are compared without case, with slashes for backslashes; the last of equal paths counts. What is only on one side pairs up by size and hash, first with first.
    """

    def index(df: DataFrame, side: str) -> DataFrame:
        path = F.lower(F.translate("path", "\\", "/"))
        last = df.groupBy(path.alias("p")).agg(F.max_by(F.struct("ord", "path", "size", "sha"), "ord").alias("r"))
        return last.select(F.col("p").alias(f"{side}p"), *(F.col(f"r.{c}").alias(f"{side}{c}") for c in ("ord", "path", "size", "sha")))

    both = index(old, "a").join(index(new, "b"), F.col("ap") == F.col("bp"), "full_outer")
    changed = both.filter("ap = bp AND NOT (asize <=> bsize AND asha <=> bsha)").select(F.lit("changed").alias("kind"), F.col("apath").alias("old_path"), F.col("bpath").alias("new_path"))
    nth = lambda s: F.row_number().over(Window.partitionBy(f"{s}size", f"{s}sha").orderBy(f"{s}ord", f"{s}p"))
    gone = both.filter("bp IS NULL").select("apath", "asize", "asha", nth("a").alias("i"))
    fresh = both.filter("ap IS NULL").select("bpath", "bsize", "bsha", nth("b").alias("j"))
    pairs = gone.join(fresh, F.expr("asize <=> bsize AND asha <=> bsha AND i = j"), "full_outer")
    kind = F.when(F.col("j").isNull(), "removed").when(F.col("i").isNull(), "added").otherwise("moved")
    return changed.unionByName(pairs.select(kind.alias("kind"), F.col("apath").alias("old_path"), F.col("bpath").alias("new_path")))


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Games (game, name, size, sha1, crc) that were added, removed or changed; of changed ones the change in number of files, and how many of the new files are re-hashed.

    A game's signature is the sorted list of its files' name:size:hash, in lower case, with CRC where SHA-1 is null.
    """

    def signed(df: DataFrame, side: str) -> DataFrame:
        h = F.lower(F.coalesce("sha1", "crc", F.lit("")))
        return df.groupBy("game").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.lower("name"), F.col("size"), h))).alias(f"{side}s"), F.collect_list(h).alias(f"{side}h")).withColumnRenamed("game", f"{side}g")

    both = signed(old, "a").join(signed(new, "b"), F.col("ag") == F.col("bg"), "full_outer")
    change = F.when(F.col("ag").isNull(), "added").when(F.col("bg").isNull(), "removed").when(F.col("as") != F.col("bs"), "changed")
    fresh = F.expr("size(filter(bh, x -> NOT array_contains(ah, x)))")
    more = F.when(change == "changed", F.size("bh") - F.size("ah"))
    return both.select(F.coalesce("ag", "bg").alias("game"), change.alias("change"), more.cast("long").alias("more_files"), F.when(change == "changed", fresh).cast("long").alias("rehashed")).filter("change IS NOT NULL")


def positional_diff(expected: DataFrame, actual: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The i-th expected against the i-th actual value of each group, padded: i, both values and whether they are the same. Rows of equal order go by value, so the result doesn't depend on where rows lie."""
    nth = F.row_number().over(Window.partitionBy("g").orderBy("o", "v"))
    side = lambda df, s: df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).alias("v")).select(F.col("g").alias(f"{s}g"), F.col("v").alias(f"{s}v"), nth.alias(f"{s}i"))
    both = side(expected, "a").join(side(actual, "b"), F.expr("ag = bg AND ai = bi"), "full_outer")
    return both.select(F.coalesce("ag", "bg").alias(group), F.coalesce("ai", "bi").cast("long").alias("i"), F.col("av").alias("expected"), F.col("bv").alias("actual"), F.col("av").eqNullSafe(F.col("bv")).alias("same"))


def best_overlap(items: DataFrame, catalog: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """The group that shares most distinct values with each key; the first by name wins a tie."""
    best = incidence.best_overlap(items.select(F.col(key).alias("k"), F.col(value).alias("v")), catalog.select(F.col(group).alias("g"), F.col(value).alias("v")))
    return best.select(F.col("k").alias(key), F.col("g").alias(group), "shared")


def resolved(items: DataFrame, catalog: DataFrame, key: str, group: str, value: str, hints: DataFrame | None = None) -> DataFrame:
    """The group that each key belongs to. A key with a hint (key, hint) takes the group that it names, whatever its case, or else the first by name that has it within, or none.

    Others take the group of most shared values (best_overlap), or where none is shared the only group that the catalog has, if it has one. Each different hint is looked up once:
    by its whole, then one of up to three letters by the first group that has it, and a longer one in the groups that have its first three letters.
    """
    keys = items.select(F.col(key).alias("k")).distinct()
    best = best_overlap(items, catalog, key, group, value).select(F.col(key).alias("k"), F.col(group).alias("best"))
    names = catalog.select(F.col(group).alias("g")).filter("g IS NOT NULL").distinct()
    sole = names.agg(F.count("*").alias("n"), F.min("g").alias("g")).select(F.when(F.col("n") == 1, F.col("g"))).scalar()
    out = keys.join(best, "k", "left")
    if hints is None:
        return out.select(F.col("k").alias(key), F.coalesce("best", sole).alias(group))
    asked = hints.select(F.col(key).alias("k"), F.lower("hint").alias("h")).filter("h <> ''")
    low = names.withColumn("l", F.lower("g"))
    each = asked.select("h").distinct()
    exact = each.join(low, F.col("h") == F.col("l")).groupBy("h").agg(F.min("g").alias("exact"))
    rest = each.join(exact, "h", "left_anti").withColumn("gram", F.substring("h", 1, 3))
    grams = low.withColumn("gram", F.explode(F.expr("array_distinct(flatten(transform(sequence(1, greatest(length(l), 1)), i -> array(substring(l, i, 1), substring(l, i, 2), substring(l, i, 3)))))")))
    short = rest.filter("length(h) <= 3").join(grams.groupBy("gram").agg(F.min("g").alias("part")), "gram").select("h", "part")
    long = rest.filter("length(h) > 3").join(grams, "gram").filter(F.contains("l", "h")).groupBy("h").agg(F.min("g").alias("part"))
    none = F.lit(None).cast(low.schema["g"].dataType)
    found = exact.withColumn("part", none).unionByName(short.unionByName(long).withColumn("exact", none))
    named = asked.join(found, "h").groupBy("k").agg(F.min("exact").alias("exact"), F.min("part").alias("part"))
    told = asked.select("k").distinct().join(named, "k", "left").select("k", F.coalesce("exact", "part").alias("named"), F.lit(True).alias("hinted"))
    out = out.join(told, "k", "left")
    return out.select(F.col("k").alias(key), F.when(F.col("hinted"), F.col("named")).otherwise(F.coalesce("best", sole)).alias(group))


def trait_diff(first: DataFrame, second: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Traits of two bags (one row a name): same, differs, only_first or only_second."""
    a = first.select(F.col(name).alias("a"), F.col(value).alias("av"))
    b = second.select(F.col(name).alias("b"), F.col(value).alias("bv"))
    verdict = F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").when(F.col("av").eqNullSafe(F.col("bv")), "same").otherwise("differs")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(name), verdict.alias("verdict"), F.col("av").alias("first"), F.col("bv").alias("second"))


def shared_chunks(left: DataFrame, right: DataFrame, digest: str = "sha256") -> DataFrame:
    """left's rows, repeated ones too, with shared: whether right has the digest. Right is reduced to its digests first."""
    has = right.select(F.col(digest).alias("_d")).dropna().distinct()
    return left.join(has, F.col(digest) == F.col("_d"), "left").withColumn("shared", F.col("_d").isNotNull()).drop("_d")


def resolve_blobs(regions: DataFrame, blobs: DataFrame, digest: str = "sha") -> DataFrame:
    """regions with their blob's columns; a region whose blob is missing fails the query when it is read."""
    b = blobs.withColumn("_there", F.lit(True))
    out = regions.join(b, digest, "left")
    return out.filter(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no blob for "), F.coalesce(F.col(digest).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)).drop("_there")


def delta(target: DataFrame, base: DataFrame, digest: str = "sha") -> DataFrame:
    """Target rows whose digest base lacks, one for each digest."""
    return target.join(base.select(digest).dropna().distinct(), digest, "left_anti").dropDuplicates([digest])


def parent_lookup(titles: DataFrame, key: str = "name", parent: str = "clone_of", value: str = "description") -> DataFrame:
    """Each title with its family: the parent, if it is listed, otherwise the title itself; one hop. parent_value is the parent's."""
    p = titles.select(F.col(key).alias("_p"), F.col(value).alias("parent_value")).dropDuplicates(["_p"])
    return titles.join(p, F.col(parent) == F.col("_p"), "left").withColumn("family", F.coalesce("_p", key)).drop("_p")


def array_lookup(tracks: DataFrame, records: DataFrame) -> DataFrame:
    """Best database hit of each track (track, v1, v2): records (ord, confidence, sums array by track from 1). Higher confidence wins, then the later record, then v2."""
    db = records.select("ord", "confidence", F.posexplode("sums").alias("at", "sum")).withColumn("t", F.col("at") + 1)
    asked = tracks.select("track", F.explode(F.array(F.struct(F.lit(1).alias("version"), F.col("v1").alias("s")), F.struct(F.lit(2).alias("version"), F.col("v2").alias("s")))).alias("x")).select("track", "x.*")
    met = asked.join(db, F.expr("track = t AND s = sum"))
    best = met.groupBy("track").agg(F.max(F.struct("confidence", "ord", "version")).alias("b"))
    return tracks.select("track").join(best, "track", "left").select("track", F.col("b.confidence").alias("confidence"), F.col("b.version").alias("version"))


def rule_division(facts: DataFrame, needs: DataFrame, entity: str, fact: str, rule: str) -> DataFrame:
    """Rules that fire for an entity: all facts that the rule needs (rule, fact) are there. Rules without needs never fire."""
    wanted = needs.select(F.col(rule).alias("r"), F.col(fact).alias("f")).distinct()
    sizes = wanted.groupBy("r").agg(F.count("*").alias("n"))
    met = facts.select(F.col(entity).alias("e"), F.col(fact).alias("f")).distinct().join(wanted, "f").groupBy("e", "r").agg(F.count("*").alias("m"))
    return met.join(sizes, "r").filter("m = n").select(F.col("e").alias(entity), F.col("r").alias(rule))


def manifest_check(manifest: DataFrame, found: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Each entry of a manifest: found, and whether its digest matches (null where it wasn't found)."""
    f = found.select(F.col(key).alias("_p"), F.col(digest).alias("_h")).dropDuplicates(["_p"])
    met = manifest.join(f, F.col(key) == F.col("_p"), "left")
    return met.select(key, F.col("_p").isNotNull().alias("found"), F.when(F.col("_p").isNotNull(), F.col(digest).eqNullSafe(F.col("_h"))).alias("matches"))


#: The longest mark of a path's end, in letters: what file systems allow a path.
MOST_SUFFIX = 4096


def signature_match(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Products whose marks (product, kind, mark, strong) files (path) carry: kind file or directory (a whole path part), extension, or string of the path's end.

    confidence is high with a strong mark, medium with two others, low with one. Suffix marks join by their length, so every kind is an equi-join; a suffix is of MOST_SUFFIX letters at most, longer than paths are.
    """
    path = F.lower(F.translate("path", "\\", "/"))
    parts = files.select(path.alias("p")).distinct().withColumn("parts", F.split("p", "/"))
    leaf = F.element_at("parts", -1)
    probes = parts.select(F.explode(F.array_union(F.array(F.struct(F.lit("file").alias("kind"), leaf.alias("m")), F.struct(F.lit("extension").alias("kind"), F.when(leaf.contains("."), F.substring_index(leaf, ".", -1)).alias("m"))), F.transform(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: F.struct(F.lit("directory").alias("kind"), x.alias("m"))))).alias("x")).select("x.*")
    lengths = sorted(r["n"] for r in marks.filter("kind = 'suffix'").select(F.length("mark").alias("n")).distinct().filter(f"n BETWEEN 1 AND {MOST_SUFFIX}").collect())  # MOST_SUFFIX numbers at most
    ends = parts.select(F.lit("suffix").alias("kind"), F.explode(F.array(*(F.expr(f"right(p, {n})") for n in lengths)) if lengths else F.array().cast("array<string>")).alias("m"))
    met = probes.unionByName(ends).distinct().join(marks.select("product", "kind", F.lower("mark").alias("m"), "strong"), ["kind", "m"])
    each = met.groupBy("product").agg(F.count_if("strong").alias("n_strong"), F.count_if(~F.col("strong")).alias("n_other"))
    return each.select("product", "n_strong", "n_other", F.when(F.col("n_strong") > 0, "high").when(F.col("n_other") > 1, "medium").otherwise("low").alias("confidence"))
