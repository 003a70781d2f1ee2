"""Queries of the engine and their SQL twins, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import hashing, paths
from lamina.operators import align, history, integrity, intents, kernels, listing, manifests, packs, sync
from lamina.plans import derived as d

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def _sides(spark, sf_dir):
    return [d.manifest(spark, sf_dir, side) for side in d.SIDES]


_THREE = f"""WITH {d.SIDES_SQL}, three AS (SELECT coalesce(b.path, l.path, r.path) AS path, b.blob AS b_blob, l.blob AS l_blob, r.blob AS r_blob,
    b.mode AS b_mode, l.mode AS l_mode, r.mode AS r_mode FROM base b FULL JOIN "left" l ON l.path = b.path FULL JOIN "right" r ON r.path = coalesce(b.path, l.path))"""
_THREE = _THREE.replace("left AS (", '"left" AS (').replace("right AS (", '"right" AS (')
_TWO = f'WITH base AS ({d.MANIFESTS_SQL["base"]}), side AS ({d.MANIFESTS_SQL["left"]})'
_KIND = "l_mode IS NOT NULL AND r_mode IS NOT NULL AND (l_mode = 'symlink') <> (r_mode = 'symlink')"


@query(f"{_THREE} SELECT path, {manifests.PRESENCE_SQL} AS outcome FROM three")
def three_way_presence(spark, sf_dir):
    rows = manifests.stacked(dict(zip("blr", _sides(spark, sf_dir), strict=True)))
    return rows.select("path", manifests.presence(F.col("b_blob"), F.col("l_blob"), F.col("r_blob")).alias("outcome"))


@query(f"{_THREE} SELECT path, {manifests.MODE_SQL} AS mode, {_KIND} AS kind_conflict FROM three")
def three_way_mode(spark, sf_dir):
    rows = manifests.stacked(dict(zip("blr", _sides(spark, sf_dir), strict=True)))
    return rows.select("path", manifests.merged_mode(F.col("b_mode"), F.col("l_mode"), F.col("r_mode")).alias("mode"), manifests.kind_conflict(F.col("l_mode"), F.col("r_mode")).alias("kind_conflict"))


_CHOICE = "CASE WHEN length(path) % 3 = 0 THEN 'ours' WHEN length(path) % 3 = 1 THEN 'theirs' END"


@query(f"""{_THREE}, planned AS (SELECT *, CASE WHEN {_KIND} THEN 'kind_conflict' ELSE {manifests.PRESENCE_SQL} END AS outcome, {_CHOICE} AS choice FROM three)
    SELECT path, CASE WHEN outcome IN ('content_merge', 'add_add', 'kind_conflict') AND choice IS NOT NULL THEN 'resolved_' || choice ELSE outcome END AS outcome,
    CASE WHEN outcome IN ('content_merge', 'add_add', 'kind_conflict') THEN CASE choice WHEN 'ours' THEN l_blob WHEN 'theirs' THEN r_blob END
    WHEN outcome IN {manifests.LEFT} THEN l_blob WHEN outcome IN {manifests.RIGHT} THEN r_blob END AS blob FROM planned""")
def merge_resolved(spark, sf_dir):
    plan = manifests.three_way(*_sides(spark, sf_dir))
    third = F.length("path") % 3
    choices = plan.select("path", F.when(third == 0, "ours").when(third == 1, "theirs").alias("choice")).where("choice is not null")
    return manifests.resolve(plan, choices)


_RENAMES = """, gone{n} AS (SELECT b.path, b.blob, row_number() OVER (PARTITION BY b.blob ORDER BY b.path) AS nth FROM base b ANTI JOIN {s} s ON s.path = b.path),
    come{n} AS (SELECT s.path, s.blob, row_number() OVER (PARTITION BY s.blob ORDER BY s.path) AS nth FROM {s} s ANTI JOIN base b ON s.path = b.path),
    ren{n} AS (SELECT g.path AS from_path, c.path AS to_path, g.blob FROM gone{n} g JOIN come{n} c ON g.blob = c.blob AND g.nth = c.nth)"""


@query(f"""{_THREE}{_RENAMES.format(n="l", s='"left"')}{_RENAMES.format(n="r", s='"right"')},
    lside AS (SELECT coalesce(from_path, path) AS path, s.blob, mode, to_path FROM "left" s LEFT JOIN renl ON to_path = path),
    rside AS (SELECT coalesce(from_path, path) AS path, s.blob, mode, to_path FROM "right" s LEFT JOIN renr ON to_path = path),
    plan AS (SELECT coalesce(b.path, l.path, r.path) AS path, b.blob AS b_blob, l.blob AS l_blob, r.blob AS r_blob, b.mode AS b_mode, l.mode AS l_mode, r.mode AS r_mode, l.to_path AS lt, r.to_path AS rt
      FROM base b FULL JOIN lside l ON l.path = b.path FULL JOIN rside r ON r.path = coalesce(b.path, l.path))
    SELECT path, coalesce(lt, rt, path) AS target, CASE WHEN lt IS NOT NULL AND rt IS NOT NULL AND lt <> rt THEN 'rename_conflict' WHEN {_KIND} THEN 'kind_conflict' ELSE {manifests.PRESENCE_SQL} END AS outcome, {manifests.MODE_SQL} AS mode FROM plan""")
def merge_plan(spark, sf_dir):
    return manifests.plan_three_way(*_sides(spark, sf_dir)).select("path", "target", "outcome", "mode")


@query(f"""{_TWO} SELECT coalesce(b.path, s.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed' WHEN b.blob <> s.blob THEN 'modified' ELSE 'mode' END AS change, b.blob AS old_blob, s.blob AS new_blob
    FROM base b FULL JOIN side s ON s.path = b.path WHERE b.path IS NULL OR s.path IS NULL OR b.blob <> s.blob OR b.mode <> s.mode""")
def manifest_diff(spark, sf_dir):
    base, left, _ = _sides(spark, sf_dir)
    return manifests.diff(base, left)


@query(_TWO + _RENAMES.format(n="", s="side") + " SELECT from_path, to_path, blob FROM ren")
def exact_renames(spark, sf_dir):
    base, left, _ = _sides(spark, sf_dir)
    return manifests.exact_renames(base, left)


@query(_THREE + _RENAMES.format(n="l", s='"left"') + _RENAMES.format(n="r", s='"right"') + " SELECT l.from_path, l.to_path AS left_path, r.to_path AS right_path FROM renl l JOIN renr r ON l.from_path = r.from_path WHERE l.to_path <> r.to_path")
def divergent_renames(spark, sf_dir):
    base, left, right = _sides(spark, sf_dir)
    ours = manifests.exact_renames(base, left).select("from_path", F.col("to_path").alias("left_path"))
    theirs = manifests.exact_renames(base, right).select("from_path", F.col("to_path").alias("right_path"))
    return ours.join(theirs, "from_path").where("left_path <> right_path")


_STAGED = f"WITH head AS ({d.MANIFESTS_SQL['base']}), staging AS ({d.STAGING_SQL}), tree AS ({d.WORKING_SQL}), eff AS (SELECT coalesce(h.path, s.path) AS path, coalesce(s.blob, h.blob) AS blob, coalesce(s.mode, h.mode) AS mode FROM head h FULL JOIN staging s ON s.path = h.path WHERE NOT coalesce(s.deleted, false))"


@query(f"{_STAGED} SELECT path, blob, mode FROM eff")
def effective_index(spark, sf_dir):
    return manifests.effective(d.manifest(spark, sf_dir, "base"), d.staging(spark, sf_dir))


@query(f"""{_STAGED}, three AS (SELECT coalesce(h.path, e.path, w.path) AS path, h.blob AS hb, h.mode AS hm, e.blob AS eb, e.mode AS em, w.blob AS wb, w.mode AS wm
    FROM head h FULL JOIN eff e ON e.path = h.path FULL JOIN tree w ON w.path = coalesce(h.path, e.path)),
    said AS (SELECT path, CASE WHEN hb IS NULL AND eb IS NOT NULL THEN 'added' WHEN hb IS NOT NULL AND eb IS NULL THEN 'deleted' WHEN hb <> eb OR hm <> em THEN 'modified' END AS staged,
    CASE WHEN eb IS NOT NULL AND wb IS NULL THEN 'deleted' WHEN eb <> wb OR em <> wm THEN 'modified' END AS unstaged, eb IS NULL AND wb IS NOT NULL AS untracked FROM three)
    SELECT * FROM said WHERE staged IS NOT NULL OR unstaged IS NOT NULL OR untracked""")
def status_two_column(spark, sf_dir):
    return manifests.status(d.manifest(spark, sf_dir, "base"), d.staging(spark, sf_dir), d.working(spark, sf_dir))


def _moves_sql(n: str, old: str, new: str) -> str:
    return f""", gone{n} AS (SELECT o.path, o.blob, row_number() OVER (PARTITION BY o.blob ORDER BY o.path) AS nth FROM {old} o ANTI JOIN {new} n ON n.path = o.path),
    come{n} AS (SELECT n.path, n.blob, row_number() OVER (PARTITION BY n.blob ORDER BY n.path) AS nth FROM {new} n ANTI JOIN {old} o ON n.path = o.path),
    ren{n} AS (SELECT g.path AS from_path, c.path AS to_path FROM gone{n} g JOIN come{n} c ON g.blob = c.blob AND g.nth = c.nth)"""


@query(f"""{_STAGED}{_moves_sql("s", "head", "eff")}{_moves_sql("w", "eff", "tree")}, three AS (SELECT coalesce(h.path, e.path, w.path) AS path, h.blob AS hb, h.mode AS hm, e.blob AS eb, e.mode AS em, w.blob AS wb, w.mode AS wm
    FROM head h FULL JOIN eff e ON e.path = h.path FULL JOIN tree w ON w.path = coalesce(h.path, e.path)),
    said AS (SELECT path, CASE WHEN path IN (SELECT from_path FROM rens) THEN NULL WHEN hb IS NULL AND eb IS NOT NULL THEN 'added' WHEN hb IS NOT NULL AND eb IS NULL THEN 'deleted' WHEN hb <> eb OR hm <> em THEN 'modified' END AS staged,
    CASE WHEN path IN (SELECT to_path FROM renw) THEN 'added' WHEN eb IS NOT NULL AND wb IS NULL THEN 'deleted' WHEN eb <> wb OR em <> wm THEN 'modified' END AS unstaged,
    (SELECT from_path FROM rens WHERE to_path = path) AS staged_from, (SELECT from_path FROM renw WHERE to_path = path) AS unstaged_from,
    eb IS NULL AND wb IS NOT NULL AND path NOT IN (SELECT to_path FROM renw) AS untracked FROM three WHERE path NOT IN (SELECT from_path FROM renw))
    SELECT * FROM said WHERE staged IS NOT NULL OR unstaged IS NOT NULL OR untracked""")
def status_renames(spark, sf_dir):
    """The two columns with renames folded into their new path."""
    head, staging, tree = d.manifest(spark, sf_dir, "base"), d.staging(spark, sf_dir), d.working(spark, sf_dir)
    return manifests.status_with_renames(head, staging, tree)


@query("SELECT sha256(coalesce(text, '')) AS blob, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def blob_dedup(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents")
    return docs.select("doc_id", hashing.text_hash(F.coalesce("text", F.lit(""))).alias("blob")).groupBy("blob").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS blob FROM documents")
def blob_ids(spark, sf_dir):
    return d.read(spark, sf_dir, "documents").select("doc_id", hashing.text_hash(F.coalesce("text", F.lit(""))).alias("blob"))


def _manifest_ids(spark, sf_dir, side):
    docs = d.manifest(spark, sf_dir, side)
    number = F.regexp_extract("path", r"/(\d+)\.", 1).cast("long")
    entry = F.struct(F.col("path").cast("binary").alias("p"), hashing.manifest_entry(F.col("path"), F.col("blob"), F.col("mode")).alias("e"))
    return docs.groupBy(F.floor(number / 100).alias("state")).agg(hashing.manifest_hash(F.collect_list(entry)).alias("manifest"))


def _manifest_sql(side: str) -> str:
    return f"""SELECT (regexp_extract(path, '/([0-9]+)\\.', 1)::BIGINT // 100)::BIGINT AS state, sha256(unhex(string_agg(hex(encode(path)) || '00' || hex(encode(blob)) || CASE WHEN mode = 'regular' THEN '' ELSE '00' || hex(encode(mode)) END, '' ORDER BY encode(path)))) AS manifest
    FROM ({d.MANIFESTS_SQL[side]}) GROUP BY 1"""


@query(_manifest_sql("base"))
def manifest_ids(spark, sf_dir):
    """A hundred documents are one state's manifest."""
    return _manifest_ids(spark, sf_dir, "base")


@query(f"SELECT state, coalesce(a.manifest = b.manifest, false) AS unchanged FROM ({_manifest_sql('base')}) a FULL JOIN ({_manifest_sql('left')}) b USING (state)")
def manifest_unchanged(spark, sf_dir):
    return manifests.unchanged(_manifest_ids(spark, sf_dir, "base"), _manifest_ids(spark, sf_dir, "left"))


_COMMITS = f"""WITH {d.EDGES_SQL}, named AS (SELECT child, list_sort(list(sha256(parent::VARCHAR))) AS parents FROM edges GROUP BY child)
    SELECT event_id AS state, sha256(unhex(hex(encode(sha256(event_id::VARCHAR || coalesce(props, '')))) || '00' || coalesce(array_to_string(list_transform(parents, lambda p: hex(encode(p)) || '00'), ''), '')
    || hex(encode(event_type)) || '00' || hex(encode(floor(epoch(ts))::BIGINT::VARCHAR)) || '00' || hex(encode('user' || user_id)) || '00' || hex(encode('user' || user_id || '@example.org')))) AS commit_id FROM events LEFT JOIN named ON child = event_id"""


@query(_COMMITS)
def commit_ids(spark, sf_dir):
    events = d.read(spark, sf_dir, "events")
    parents = d.commit_edges(spark, sf_dir).groupBy("child").agg(F.collect_list(hashing.text_hash(F.col("parent").cast("string"))).alias("parents"))
    manifest = hashing.text_hash(F.concat(F.col("event_id").cast("string"), F.coalesce("props", F.lit(""))))
    author = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    joined = events.join(parents, events["event_id"] == parents["child"], "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    stamp = F.unix_timestamp("ts").cast("string")
    return joined.select(F.col("event_id").alias("state"), hashing.commit_hash(manifest, F.col("parents"), F.col("event_type"), stamp, author, F.concat(author, F.lit("@example.org"))).alias("commit_id"))


@query("""WITH words AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda line: list_transform(string_split(line, ' '), lambda w: sha256(encode('Token') || '\\x00'::BLOB || encode(w) || '\\x00'::BLOB))) AS w FROM documents),
    lines AS (SELECT doc_id, list_transform(w, lambda x: sha256(encode('Statement') || '\\x00'::BLOB || '\\x00'::BLOB || unhex(array_to_string(x, '')))) AS l FROM words)
    SELECT doc_id, len(l)::BIGINT AS n_children, sha256(encode('Block') || '\\x00'::BLOB || '\\x00'::BLOB || unhex(array_to_string(l, ''))) AS node FROM lines""")
def merkle_node_ids(spark, sf_dir):
    """Documents as trees of lines and words: three levels of node ids in one narrow projection."""
    leaf = lambda w: hashing.node_hash(F.lit("Token"), w)
    line = lambda x: hashing.node_hash(F.lit("Statement"), F.lit(""), F.transform(F.split(x, " "), leaf))
    docs = d.read(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line).alias("lines"))
    return docs.select("doc_id", F.size("lines").cast("long").alias("n_children"), hashing.node_hash(F.lit("Block"), F.lit(""), F.col("lines")).alias("node"))


def _newest(spark, sf_dir, user: str):
    return d.branches(spark, sf_dir).where(F.col("name") == user).select("state")


_WALK = f"""WITH RECURSIVE {d.EDGES_SQL}, {d.BRANCHES_SQL}, """
_CLOSURE = "{n}(state, depth) AS (SELECT state, 0 FROM branches WHERE name = '{tip}' UNION SELECT e.parent, c.depth + 1 FROM {n} c JOIN edges e ON e.child = c.state)"
_FROM = "u1"
_OTHER = "u2"


@query(_WALK + _CLOSURE.format(n="c", tip=_FROM) + " SELECT state, min(depth)::INTEGER AS depth FROM c GROUP BY state HAVING min(depth) > 0")
def ancestors(spark, sf_dir):
    return history.ancestors_of(d.commit_edges(spark, sf_dir), _newest(spark, sf_dir, _FROM))


@query(_WALK + f"""c(state, depth, path) AS (SELECT state, 0, [0::INTEGER] FROM branches WHERE name = '{_FROM}' UNION ALL
      SELECT e.parent, any_value(c.depth) + 1, min(list_append(c.path, e.ord::INTEGER)) FROM c JOIN edges e ON e.child = c.state WHERE c.depth < 50 GROUP BY e.parent),
    met AS (SELECT DISTINCT ON (state) state, depth, path FROM c ORDER BY state, depth)
    SELECT state, depth::INTEGER AS depth, row_number() OVER (ORDER BY depth, path) - 1 AS visit FROM met ORDER BY visit LIMIT 50""")
def log_topn(spark, sf_dir):
    """The log's limit is its feature. A level has a state at least, so 50 levels hold the first 50."""
    return history.log(d.commit_edges(spark, sf_dir), _newest(spark, sf_dir, _FROM), 50)


@query(_WALK + _CLOSURE.format(n="a", tip=_FROM) + ", " + _CLOSURE.format(n="b", tip=_OTHER) + " SELECT state, (x.depth + y.depth)::INTEGER AS distance FROM (SELECT state, min(depth) AS depth FROM a GROUP BY state) x JOIN (SELECT state, min(depth) AS depth FROM b GROUP BY state) y USING (state) ORDER BY distance, state LIMIT 1")
def merge_base(spark, sf_dir):
    return history.merge_base(d.commit_edges(spark, sf_dir), _newest(spark, sf_dir, _FROM), _newest(spark, sf_dir, _OTHER))


@query(_WALK + _CLOSURE.format(n="c", tip=_FROM) + " SELECT state, state IN (SELECT state FROM c) AS is_ancestor FROM branches")
def is_ancestor(spark, sf_dir):
    return history.is_ancestor(d.commit_edges(spark, sf_dir), _newest(spark, sf_dir, _FROM), d.branches(spark, sf_dir).select("state"))


_CHAIN = f"WITH RECURSIVE {d.EDGES_SQL}, {d.BRANCHES_SQL}, chain(tip, state, distance) AS (SELECT state, state, 0::BIGINT FROM branches UNION ALL SELECT c.tip, e.parent, c.distance + 1 FROM chain c JOIN edges e ON e.child = c.state AND e.ord = 0)"


@query(f"{_CHAIN} SELECT tip, state, distance FROM chain")
def linear_chain(spark, sf_dir):
    return history.linear_chain(d.commit_edges(spark, sf_dir), d.branches(spark, sf_dir).select("state"))


@query(f"{_CHAIN}, ends AS (SELECT tip, max(distance) AS stop FROM chain GROUP BY tip) SELECT state, stop - distance AS step FROM chain JOIN ends USING (tip) WHERE distance < stop")
def bisect_candidates(spark, sf_dir):
    """Every branch is bisected from its first commit (good) to its tip (bad)."""
    edges, tips = d.commit_edges(spark, sf_dir), d.branches(spark, sf_dir).select("state")
    chain = history.linear_chain(edges, tips)
    return history.bisect_candidates(edges, chain.groupBy("tip").agg(F.max_by("state", "distance").alias("state")).select("state"), tips)


_REACH = _WALK + "c(state) AS (SELECT state FROM branches UNION SELECT e.parent FROM c JOIN edges e ON e.child = c.state)"


@query(f"{_REACH} SELECT state FROM c")
def reachable_states(spark, sf_dir):
    return history.closure(d.commit_edges(spark, sf_dir), d.branches(spark, sf_dir)).select("state")


@query(f"""{_REACH}, {d.BLOBS_SQL}, live AS (SELECT DISTINCT blob FROM blobs WHERE state IN (SELECT state FROM c)), sizes AS (SELECT blob, max(size) AS size FROM blobs GROUP BY blob)
    SELECT 'state' AS kind, count(DISTINCT state) AS items, 0::BIGINT AS bytes FROM blobs WHERE state NOT IN (SELECT state FROM c)
    UNION ALL SELECT 'blob', count(*), coalesce(sum(size), 0)::BIGINT FROM sizes WHERE blob NOT IN (SELECT blob FROM live)""")
def gc_report(spark, sf_dir):
    kept = d.state_blobs(spark, sf_dir)
    states, blobs = integrity.reachable(d.commit_edges(spark, sf_dir), d.branches(spark, sf_dir), kept)
    return integrity.gc_report(kept, states, blobs)


_REFS = "allrefs AS (SELECT 'u' || user_id AS name, event_id + CASE WHEN user_id % 7 = 0 THEN 1000000000 ELSE 0 END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)"


def _refs(spark, sf_dir):
    """Every user's branch; those of users divisible by 7 point nowhere."""
    last = d.read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("state"))
    lost = F.when(F.col("user_id") % 7 == 0, F.lit(1000000000)).otherwise(F.lit(0))
    return last.select(F.concat(F.lit("u"), "user_id").alias("name"), (F.col("state") + lost).alias("state"))


@query(f"WITH {_REFS} SELECT name, state FROM allrefs WHERE state NOT IN (SELECT event_id FROM events)")
def dangling_refs(spark, sf_dir):
    return integrity.dangling_refs(_refs(spark, sf_dir), d.read(spark, sf_dir, "events").select(F.col("event_id").alias("state")))


@query(f"""WITH {d.EDGES_SQL}, {_REFS}, {d.BLOBS_SQL}, held AS (SELECT event_id AS state FROM events WHERE event_id % 97 <> 5), there AS (SELECT DISTINCT blob FROM blobs WHERE blob NOT LIKE '00%')
    SELECT 'dangling_ref' AS kind, name AS detail FROM allrefs WHERE state NOT IN (SELECT state FROM held)
    UNION ALL SELECT DISTINCT 'missing_parent', parent::VARCHAR FROM edges WHERE parent NOT IN (SELECT state FROM held)
    UNION ALL SELECT 'missing_manifest', state::VARCHAR FROM held WHERE state NOT IN (SELECT state FROM blobs)
    UNION ALL SELECT DISTINCT 'missing_blob', blob FROM blobs WHERE blob NOT IN (SELECT blob FROM there)
    UNION ALL SELECT DISTINCT 'orphaned_manifest', state::VARCHAR FROM blobs WHERE state NOT IN (SELECT state FROM held)""")
def fsck_findings(spark, sf_dir):
    """A store that lost some states and all blobs of one shard."""
    states = d.read(spark, sf_dir, "events").where("event_id % 97 <> 5").select(F.col("event_id").alias("state"))
    kept = d.state_blobs(spark, sf_dir)
    there = kept.where("blob not like '00%'").select("blob").distinct()
    return integrity.fsck(d.commit_edges(spark, sf_dir), states, kept, there, _refs(spark, sf_dir))


@query(f"WITH {d.BLOBS_SQL} SELECT blob, lag(blob) OVER (PARTITION BY substr(blob, 1, 2) ORDER BY blob) AS base FROM (SELECT DISTINCT blob FROM blobs)")
def delta_base(spark, sf_dir):
    return integrity.delta_bases(d.state_blobs(spark, sf_dir))


@query(f"WITH {d.BLOBS_SQL} SELECT substr(blob, 1, 2) AS shard, count(*) AS items, sum(size)::BIGINT AS bytes FROM (SELECT blob, max(size) AS size FROM blobs GROUP BY blob) GROUP BY 1")
def repack_sizes(spark, sf_dir):
    return integrity.repack_sizes(d.state_blobs(spark, sf_dir))


@query(f"{_REACH.replace('c(state)', 'c(state)')}, d(state, depth) AS (SELECT state, 0 FROM branches UNION SELECT e.parent, d.depth + 1 FROM d JOIN edges e ON e.child = d.state) SELECT state, min(depth)::INTEGER AS depth FROM d WHERE state % 2 = 1 GROUP BY state")
def missing_states(spark, sf_dir):
    """A fetch into a store that holds every even state."""
    held = d.read(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("state"))
    return sync.missing_states(d.commit_edges(spark, sf_dir), d.branches(spark, sf_dir), held)


@query(_WALK + "c(state) AS (SELECT state FROM branches WHERE state % 5 <> 0 UNION SELECT e.parent FROM c JOIN edges e ON e.child = c.state WHERE e.parent % 5 <> 0) SELECT state FROM c")
def upload_set(spark, sf_dir):
    """A push to a store that holds every fifth state."""
    held = d.read(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("state"))
    return sync.upload_set(d.commit_edges(spark, sf_dir), d.branches(spark, sf_dir), held)


@query(f"WITH {d.EDGES_SQL}, held AS (SELECT event_id AS state FROM events WHERE event_id % 3 <> 0) SELECT DISTINCT child AS state FROM edges WHERE child IN (SELECT state FROM held) AND parent NOT IN (SELECT state FROM held)")
def shallow_boundaries(spark, sf_dir):
    held = d.read(spark, sf_dir, "events").where("event_id % 3 <> 0").select(F.col("event_id").alias("state"))
    return sync.shallow_boundaries(d.commit_edges(spark, sf_dir), held)


def _nodes(spark, sf_dir):
    """Orders as parents: lines in order are the old children, in order of part the new ones; the key is what is shipped."""
    lines = d.read(spark, sf_dir, "lineitem")
    from pyspark.sql import Window as W

    key = F.concat_ws("|", "l_returnflag", "l_linestatus")
    new = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"))
    own = [F.floor(F.col("l_orderkey") / 1000).alias("file"), F.col("l_orderkey").alias("parent")]
    old_rows = lines.select(*own, F.lit("old").alias("side"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).alias("pos"), key.alias("key"))
    new_rows = lines.select(*own, F.lit("new").alias("side"), new.alias("pos"), F.when(F.col("l_partkey") % 7 == 0, F.concat(key, F.lit("*"))).otherwise(key).alias("key"))
    return old_rows.unionByName(new_rows)


_NODES = """nodes AS (SELECT l_orderkey // 1000 AS file, l_orderkey AS parent, 'old' AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INTEGER AS pos, l_returnflag || '|' || l_linestatus AS key FROM lineitem
    UNION ALL SELECT l_orderkey // 1000, l_orderkey, 'new', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate)::INTEGER, l_returnflag || '|' || l_linestatus || CASE WHEN l_partkey % 7 = 0 THEN '*' ELSE '' END FROM lineitem)"""


@query(f"WITH {_NODES} SELECT file, parent, side, pos, key, (row_number() OVER w - 1)::INTEGER AS occurrence, CASE WHEN count(*) OVER (PARTITION BY file, side, parent, key) > 1 THEN (row_number() OVER w - 1)::INTEGER END AS duplicate FROM nodes WINDOW w AS (PARTITION BY file, side, parent, key ORDER BY pos)")
def occurrence_index(spark, sf_dir):
    return align.occurrence_index(_nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, met AS (SELECT file, parent, key, count(*) FILTER (side = 'old') AS a, count(*) FILTER (side = 'new') AS b, min(pos) FILTER (side = 'old') AS old_pos, min(pos) FILTER (side = 'new') AS new_pos FROM nodes GROUP BY file, parent, key)
    SELECT file, parent, old_pos, new_pos FROM met WHERE a = 1 AND b = 1""")
def unique_bijective_pairs(spark, sf_dir):
    return align.unique_pairs(_nodes(spark, sf_dir))


@query(f"""WITH {_NODES}, n AS (SELECT *, row_number() OVER (PARTITION BY file, side, parent, key ORDER BY pos) AS nth FROM nodes),
    met AS (SELECT file, parent, key, nth, min(pos) FILTER (side = 'old') AS old_pos, min(pos) FILTER (side = 'new') AS new_pos FROM n GROUP BY file, parent, key, nth)
    SELECT file, parent, old_pos, new_pos FROM met WHERE old_pos IS NOT NULL AND new_pos IS NOT NULL""")
def in_order_pairs(spark, sf_dir):
    return align.in_order_pairs(_nodes(spark, sf_dir))


@query(f"WITH {_NODES}, l AS (SELECT file, parent, list(key ORDER BY pos) FILTER (side = 'old') AS a, list(key ORDER BY pos) FILTER (side = 'new') AS b FROM nodes GROUP BY file, parent) SELECT file, parent, CASE WHEN a = b THEN 'equal' ELSE 'reordered' END AS \"order\" FROM l WHERE list_sort(a) = list_sort(b)")
def reordered_children(spark, sf_dir):
    return align.reordered(_nodes(spark, sf_dir))


@query(f"WITH {_NODES}, p AS (SELECT file, parent, side, sha256(string_agg(key, ',' ORDER BY pos)) AS fingerprint FROM nodes GROUP BY ALL), u AS (SELECT file, side, fingerprint, min(parent) AS parent FROM p GROUP BY ALL HAVING count(*) = 1) SELECT o.file, o.parent AS old_parent, n.parent AS new_parent FROM u o JOIN u n ON o.file = n.file AND o.fingerprint = n.fingerprint AND o.side = 'old' AND n.side = 'new'")
def fingerprint_pairs(spark, sf_dir):
    """Parents of a file whose children's fingerprint is unique on both sides."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])
    prints = _nodes(spark, sf_dir).groupBy("file", "side", "parent").agg(hashing.text_hash(F.array_join(keys, ",")).alias("key"))
    nodes = prints.select("file", F.lit(0).alias("parent"), "side", F.col("parent").alias("pos"), "key")
    return align.unique_pairs(nodes).select("file", F.col("old_pos").alias("old_parent"), F.col("new_pos").alias("new_parent"))


def _lines(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents")
    old = F.coalesce("text", F.lit(""))
    new = F.when(F.col("doc_id") % 4 == 0, F.concat(old, F.lit("\nadded line\nadded line"))).otherwise(F.regexp_replace(old, "^[^\n]*", "first line"))
    split = lambda side, text: docs.select(F.col("doc_id").alias("file"), F.lit(side).alias("side"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return split("old", old).unionByName(split("new", new))


_LINES = """texts AS (SELECT doc_id, coalesce(text, '') AS a, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') || chr(10) || 'added line' || chr(10) || 'added line' ELSE regexp_replace(coalesce(text, ''), '^[^\\n]*', 'first line') END AS b FROM documents),
    split AS (SELECT doc_id AS file, 'old' AS side, string_split(a, chr(10)) AS l FROM texts UNION ALL SELECT doc_id, 'new', string_split(b, chr(10)) FROM texts),
    lines AS (SELECT file, side, unnest(l) AS text, (unnest(range(len(l))))::INTEGER AS line FROM split)"""


@query(f"WITH {_LINES} SELECT file, text, (count(*) FILTER (side = 'new') - count(*) FILTER (side = 'old'))::BIGINT AS n FROM lines GROUP BY file, text HAVING n > 0")
def lines_added(spark, sf_dir):
    return align.lines_added(_lines(spark, sf_dir))


@query(f"WITH {_LINES} SELECT n.file, n.line FROM lines n WHERE n.side = 'new' AND NOT EXISTS (SELECT 1 FROM lines o WHERE o.side = 'old' AND o.file = n.file AND o.text = n.text)")
def changed_lines(spark, sf_dir):
    return align.changed_lines(_lines(spark, sf_dir))


_OPS = ("rename_identifier", "edit_payload", "insert_subtree", "delete_subtree", "move_node", "move_subtree", "reorder_children", "set_trivia", "set_root_trailing_trivia")
_KINDS = ("Statement", "Declaration", "Literal", "Comment", "Token", "Identifier")


def _mutations(spark, sf_dir):
    pick = lambda some, by: F.element_at(F.array(*[F.lit(x) for x in some]), (by % len(some) + 1).cast("int"))
    events, by = d.read(spark, sf_dir, "events"), F.col("event_id")
    rows = events.select(F.col("user_id").alias("file"), by.alias("seq"), pick(_OPS, by).alias("op"), pick(_KINDS, F.floor(by / 9)).alias("kind"), (by % 5 < 2).alias("at_start"), (by % 3).alias("site"))
    return rows.withColumn("intent", intents.intent(F.col("op"), F.col("kind"), F.col("at_start")))


_LIST = lambda some: "[" + ", ".join(f"'{x}'" for x in some) + "]"
_MUTATIONS = f"mutations AS (SELECT *, {intents.INTENT_SQL} AS intent FROM (SELECT user_id AS file, event_id AS seq, ({_LIST(_OPS)})[event_id % {len(_OPS)} + 1] AS op, ({_LIST(_KINDS)})[event_id // 9 % {len(_KINDS)} + 1] AS kind, event_id % 5 < 2 AS at_start, event_id % 3 AS site FROM events))"


@query(f"WITH {_MUTATIONS} SELECT file, intent, count(*) AS n FROM mutations GROUP BY file, intent")
def intent_counts(spark, sf_dir):
    return _mutations(spark, sf_dir).groupBy("file", "intent").agg(F.count("*").alias("n"))


@query(f"WITH {_MUTATIONS} SELECT file, min(seq) AS at, min(intent) AS intent, count(*) AS n FROM mutations GROUP BY file, CASE WHEN intent IN ('set_trivia', 'set_root_trailing_trivia') THEN 'f' ELSE seq::VARCHAR END")
def compact_intents(spark, sf_dir):
    return intents.compact(_mutations(spark, sf_dir))


_ALWAYS = ", ".join(f"'{a}|{b}'" for a, b in sorted(intents.ALWAYS_DISJOINT))
_PAY = "('rename_identifier', 'edit_literal', 'edit_payload')"


@query(f"""WITH {_MUTATIONS}, n AS (SELECT *, lead(intent) OVER w AS other, lead(site) OVER w AS other_site FROM mutations WINDOW w AS (PARTITION BY file ORDER BY seq)),
    x AS (SELECT seq, intent AS a, other AS b, site = other_site AS same FROM n WHERE other IS NOT NULL)
    SELECT seq, a, b, a || '|' || b IN ({_ALWAYS}) OR (NOT same AND (a IN {_PAY} AND (b IN {_PAY} OR b = 'set_trivia') OR a = 'set_trivia' AND (b IN {_PAY} OR b = 'set_trivia') OR a = 'insert_subtree' AND b = 'insert_subtree' OR a = 'move_subtree' AND b = 'move_subtree'))
    OR (same AND (a IN ('move_node', 'move_subtree') AND b IN {_PAY} OR a IN {_PAY} AND b IN ('move_node', 'move_subtree'))) AS disjoint FROM x""")
def overlap_matrix(spark, sf_dir):
    """Neighbouring mutations of a file against the disjointness rules."""
    from pyspark.sql import Window as W

    order = W.partitionBy("file").orderBy("seq")
    rows = _mutations(spark, sf_dir).select("seq", F.col("intent").alias("a"), F.lead("intent").over(order).alias("b"), (F.col("site") == F.lead("site").over(order)).alias("same")).where("b is not null")
    return rows.select("seq", "a", "b", intents.disjoint(F.col("a"), F.col("b"), F.col("same")).alias("disjoint"))


_EXT = " ".join(paths.LANGUAGES.values()).split()


def _named(spark, sf_dir):
    extra = ["go.mod", "x/go.mod", "a.b/README", ".gitignore", "notes.md"]
    suffix = F.element_at(F.array(*[F.lit(x) for x in [*["." + e for e in _EXT], *["/" + x for x in extra], ".RS", ""]]), (F.col("doc_id") % (len(_EXT) + len(extra) + 2) + 1).cast("int"))
    return d.read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/f"), "doc_id", suffix).alias("path"))


_NAMED = f"named AS (SELECT doc_id, source || '/f' || doc_id || ({_LIST([*['.' + e for e in _EXT], '/go.mod', '/x/go.mod', '/a.b/README', '/.gitignore', '/notes.md', '.RS', ''])})[doc_id % {len(_EXT) + 7} + 1] AS path FROM documents)"
_LANG = "CASE " + "WHEN regexp_extract(path, '[^/]*$') = 'go.mod' THEN 'gomod' " + " ".join(f"WHEN string_split(path, '.')[-1] IN ({', '.join(repr(e) for e in v.split())}) THEN '{k}'" for k, v in paths.LANGUAGES.items()) + " END"


@query(f"WITH {_NAMED} SELECT doc_id, path, {_LANG} AS language FROM named")
def lang_of_path(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", "path", paths.language(F.col("path")).alias("language"))


@query("SELECT doc_id, doc_id % 10 = 3 AS is_binary FROM documents")
def is_binary(spark, sf_dir):
    """A tenth of the contents gets a NUL byte or a broken character."""
    body = F.when(F.col("doc_id") % 20 == 3, F.concat(F.col("text").cast("binary"), F.lit(b"a\x00b"))).when(F.col("doc_id") % 20 == 13, F.concat(F.col("text").cast("binary"), F.lit(b"\xc3("))).otherwise(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return d.read(spark, sf_dir, "documents").select("doc_id", paths.is_binary(F.coalesce(body, F.lit(b"\x00"))).alias("is_binary"))


@query(f"""WITH {d.BRANCHES_SQL}, refs AS (SELECT 1 AS rank, name, state FROM branches UNION ALL SELECT 2, name, state + 1 FROM branches WHERE state % 3 <> 1 UNION ALL SELECT 2, 't' || name, state FROM branches UNION ALL SELECT 3, 'o' || name, state FROM branches UNION ALL SELECT 0, 'HEAD', min(state) FROM branches),
    names AS (SELECT DISTINCT name FROM refs UNION ALL SELECT 'head'), met AS (SELECT n.name, r.state, row_number() OVER (PARTITION BY n.name ORDER BY r.rank, r.state) AS k FROM names n JOIN refs r ON r.name = n.name OR (r.rank = 0 AND upper(n.name) = r.name)) SELECT name, state FROM met WHERE k = 1""")
def ref_priority(spark, sf_dir):
    heads = d.branches(spark, sf_dir)
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    refs = kind(heads, "branch").unionByName(kind(heads.where("state % 3 <> 1").withColumn("state", F.col("state") + 1), "tag"))
    refs = refs.unionByName(kind(heads.withColumn("name", F.concat(F.lit("t"), "name")), "tag")).unionByName(kind(heads.withColumn("name", F.concat(F.lit("o"), "name")), "remote"))
    refs = refs.unionByName(kind(heads.agg(F.lit("HEAD").alias("name"), F.min("state").alias("state")), "head"))
    names = refs.select("name").distinct().unionByName(spark.createDataFrame([("head",)], "name string"))
    return history.resolve_ref(refs, names)


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' bytes' WHEN n_chars < 1048576 THEN printf('%.1f KiB', n_chars / 1024.0) ELSE printf('%.1f MiB', n_chars / 1048576.0) END AS size FROM documents")
def size_text(spark, sf_dir):
    return d.read(spark, sf_dir, "documents").select("doc_id", paths.size_text(F.col("n_chars")).alias("size"))


def _triples(spark, sf_dir):
    """base, left and right texts of every document; all sides have it and change it."""
    docs = d.read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    left = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ours\n"), text)).otherwise(F.regexp_replace(text, "^[^\n]*", "ours"))
    right = F.when(F.col("doc_id") % 2 == 0, F.concat(text, F.lit("\ntheirs"))).otherwise(F.regexp_replace(text, "^[^\n]*", "theirs"))
    return docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), text.alias("base"), left.alias("left"), right.alias("right"))


def _sources(spark, sf_dir):
    """Events as JSON and orders as small programs: path, old, new."""
    events = d.read(spark, sf_dir, "events")
    body = F.format_string('{\n  "type": "%s",\n  "user": %d,\n  "props": %s\n}\n', "event_type", "user_id", F.coalesce("props", F.lit("null")))
    edited = F.when(F.col("event_id") % 2 == 0, F.regexp_replace(body, '"user": (\\d+)', '"user": $1,\n  "seen": true')).otherwise(F.regexp_replace(body, '"type": "', '"type": "x'))
    json = events.select(F.format_string("e/%d.json", "event_id").alias("path"), body.alias("old"), edited.alias("new"))
    orders = d.read(spark, sf_dir, "orders")
    code = F.format_string("fn order_%d() {\n    let status = \"%s\";\n    let total = %d;\n    ship(status, total);\n}\n", "o_orderkey", "o_orderstatus", F.floor("o_totalprice"))
    changed = F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(code, "ship", "send")).when(F.col("o_orderkey") % 3 == 1, F.concat(code, F.lit("\nfn added() {\n}\n"))).otherwise(F.regexp_replace(code, "let total = \\d+", "let total = 0"))
    return json.unionByName(orders.select(F.format_string("o/%d.rs", "o_orderkey").alias("path"), code.alias("old"), changed.alias("new")))


_DOCS = "t AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id, coalesce(text, '') AS t FROM documents)"


@query(f"""WITH {_DOCS} SELECT path, 0::INTEGER AS seq, 'insert' AS op, 0::INTEGER AS line, 'ours' AS content FROM t WHERE doc_id % 3 = 0 OR t = ''
    UNION ALL SELECT path, 0, 'delete', 0, string_split(t, chr(10))[1] FROM t WHERE doc_id % 3 <> 0 AND t <> ''
    UNION ALL SELECT path, 1, 'insert', 0, 'ours' FROM t WHERE doc_id % 3 <> 0 AND t <> ''""")
def text_diff(spark, sf_dir):
    return kernels.text_diff(_triples(spark, sf_dir).select("path", F.col("base").alias("old"), F.col("left").alias("new")))


@query(f"""WITH {_DOCS}, m AS (SELECT path, NOT (t = '' OR doc_id % 3 <> 0 AND (doc_id % 2 <> 0 OR NOT contains(t, chr(10)))) AS clean,
      CASE WHEN doc_id % 3 <> 0 THEN regexp_replace(t, '^[^\\n]*', 'ours') WHEN doc_id % 2 = 0 THEN 'ours' || chr(10) || t ELSE 'ours' || chr(10) || regexp_replace(t, '^[^\\n]*', 'theirs') END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'theirs' ELSE '' END AS text FROM t)
    SELECT path, clean, sha256(CASE WHEN clean THEN text ELSE '' END) AS blob, CASE WHEN clean THEN '' ELSE 'line 0' END AS message FROM m""")
def text_merge(spark, sf_dir):
    return kernels.text_merge(_triples(spark, sf_dir)).select("path", "clean", hashing.text_hash(F.coalesce("text", F.lit(""))).alias("blob"), "message")


@query("""WITH v AS (SELECT 'f' || doc_id // 4 AS path, doc_id, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS v, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT path, doc_id, v, unnest(l) AS text, unnest(range(len(l)))::INTEGER AS line FROM v), named AS (SELECT path, v, line, text || '#' || line AS content FROM lines),
    runs AS (SELECT path, content, v, v - row_number() OVER (PARTITION BY path, content ORDER BY v) AS run FROM named),
    since AS (SELECT path, content, min(v) AS low, max(v) AS high FROM runs GROUP BY path, content, run), last AS (SELECT path, max(v) AS v FROM v GROUP BY path)
    SELECT n.path, n.line, b.doc_id AS state, n.content FROM named n JOIN last USING (path, v) JOIN since s ON s.path = n.path AND s.content = n.content AND s.high = n.v JOIN v b ON b.path = n.path AND b.v = s.low""")
def blame(spark, sf_dir):
    """Four documents in order are the versions of a file; each line bears its number, so that it is unique."""
    docs = d.read(spark, sf_dir, "documents")
    number = F.floor(F.col("doc_id") / 4)
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.concat(line, F.lit("#"), i.cast("string"))), "\n")
    return kernels.blame(docs.select(F.concat(F.lit("f"), number).alias("path"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("state"), text.alias("text")))


def _node_sql(kind: str, payload: str, *children: str) -> str:
    """The id of a node whose payload is an SQL expression."""
    below = " || ".join(f"unhex({c})" for c in children) or "''::BLOB"
    return f"sha256(encode('{kind}') || '\\x00'::BLOB || encode({payload}) || '\\x00'::BLOB || {below})"


def _token(text: str, kind: str = "Token") -> str:
    return _node_sql(kind, f"'{text}'")


_SEEN = _node_sql("Field", "''", _token('"seen"', "Literal"), _token(":"), _token("true", "Literal"))
_ADDED = _node_sql("Function", "''", _token("fn"), _token("added", "Identifier"), _node_sql("group", "''", _token("("), _token(")")), _node_sql("group", "''", _token("{"), _token("}")))


@query(f"""SELECT 'e/' || event_id || '.json' AS path, 0::INTEGER AS seq, 'insert_subtree' AS op, 'insert_subtree' AS intent, {_SEEN} AS node, '' AS payload FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT 'e/' || event_id || '.json', 1, 'insert_subtree', 'insert_subtree', {_token(",")}, '' FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT 'e/' || event_id || '.json', 0, 'edit_payload', 'edit_literal', {_node_sql("Literal", "'\"' || event_type || '\"'")}, '"x' || event_type || '"' FROM events WHERE event_id % 2 <> 0
    UNION ALL SELECT 'o/' || o_orderkey || '.rs', 0, 'rename_identifier', 'rename_identifier', {_token("ship", "Identifier")}, 'send' FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'o/' || o_orderkey || '.rs', 0, 'insert_subtree', 'insert_subtree', {_ADDED}, '' FROM orders WHERE o_orderkey % 3 = 1
    UNION ALL SELECT 'o/' || o_orderkey || '.rs', 0, 'edit_payload', 'edit_literal', {_node_sql("Literal", "floor(o_totalprice)::BIGINT::VARCHAR")}, '0' FROM orders WHERE o_orderkey % 3 = 2 AND floor(o_totalprice) <> 0""")
def ast_diff(spark, sf_dir):
    """Each edit of the sources is one mutation, or a field and its comma."""
    return kernels.structural_diff(_sources(spark, sf_dir), parents=False).select("path", "seq", "op", "intent", "node", "payload")


@query()
def ast_alignment(spark, sf_dir):
    return kernels.alignment(_sources(spark, sf_dir))


_TEXTS = """made AS (SELECT 'e/' || event_id || '.json' AS path, '{' || chr(10) || '  "type": "' || event_type || '",' || chr(10) || '  "user": ' || user_id || ',' || chr(10) || '  "props": ' || coalesce(props, 'null') || chr(10) || '}' || chr(10) AS old,
      CASE WHEN event_id % 2 = 0 THEN '{' || chr(10) || '  "type": "' || event_type || '",' || chr(10) || '  "user": ' || user_id || ',' || chr(10) || '  "seen": true,' || chr(10) || '  "props": ' || coalesce(props, 'null') || chr(10) || '}' || chr(10)
      ELSE '{' || chr(10) || '  "type": "x' || event_type || '",' || chr(10) || '  "user": ' || user_id || ',' || chr(10) || '  "props": ' || coalesce(props, 'null') || chr(10) || '}' || chr(10) END AS new FROM events
    UNION ALL SELECT 'o/' || o_orderkey || '.rs', code(o_orderkey, o_orderstatus, floor(o_totalprice)::BIGINT::VARCHAR, 'ship', ''),
      CASE o_orderkey % 3 WHEN 0 THEN code(o_orderkey, o_orderstatus, floor(o_totalprice)::BIGINT::VARCHAR, 'send', '') WHEN 1 THEN code(o_orderkey, o_orderstatus, floor(o_totalprice)::BIGINT::VARCHAR, 'ship', chr(10) || 'fn added() {' || chr(10) || '}' || chr(10)) ELSE code(o_orderkey, o_orderstatus, '0', 'ship', '') END FROM orders)"""


def _made() -> str:
    """The sources as SQL makes them, the template of a program written out where it is called."""
    import re

    body = "'fn order_' || {0} || '() {{' || chr(10) || '    let status = \"' || {1} || '\";' || chr(10) || '    let total = ' || {2} || ';' || chr(10) || '    ' || {3} || '(status, total);' || chr(10) || '}}' || chr(10) || {4}"
    return re.sub(r"code\((\w+), (\w+), ('0'|floor\(\w+\)::BIGINT::VARCHAR), ('\w+'), (''|chr\(10\)(?: \|\| (?:'[^']*'|chr\(10\)))+)\)", lambda m: body.format(*m.groups()), _TEXTS)


@query(f"WITH {_made()} SELECT path, sha256(new) AS blob FROM made")
def ast_apply(spark, sf_dir):
    """The mutations from the old text to the new one, applied to the old text, give the new one."""
    return kernels.applied_diff(_sources(spark, sf_dir)).select("path", hashing.text_hash(F.col("text")).alias("blob"))


@query(f"WITH {_made()} SELECT path, true AS clean, sha256(CASE WHEN path LIKE 'o/%' THEN '// note' || chr(10) || new ELSE replace(new, '\"props\": ', '\"props\":  ') END) AS blob, '' AS message FROM made")
def ast_merge(spark, sf_dir):
    """The edited side against one that adds a comment or space."""
    rows = _sources(spark, sf_dir)
    other = F.when(F.col("path").endswith(".rs"), F.concat(F.lit("// note\n"), F.col("old"))).otherwise(F.regexp_replace("old", '"props": ', '"props":  '))
    return kernels.merge_files(rows.select("path", F.col("old").alias("base"), F.col("new").alias("left"), other.alias("right"))).select("path", "clean", hashing.text_hash(F.coalesce("text", F.lit(""))).alias("blob"), "message")


@query("SELECT 'e/' || event_id || '.json' AS path, true AS parsed, true AS same FROM events UNION ALL SELECT 'o/' || o_orderkey || '.rs', true, true FROM orders")
def json_roundtrip(spark, sf_dir):
    return kernels.round_trip(_sources(spark, sf_dir).select("path", F.col("old").alias("text")))


@query()
def syntax_nodes(spark, sf_dir):
    return kernels.syntax_nodes(_sources(spark, sf_dir).select("path", F.col("old").alias("text")))


@query(f"WITH {_NODES}, n AS (SELECT file, parent, count(*) FILTER (side = 'old') * count(*) FILTER (side = 'new') AS \"cross\" FROM nodes GROUP BY file, parent) SELECT file, parent, \"cross\" FROM n WHERE \"cross\" > 16")
def wide_lists(spark, sf_dir):
    """Orders have too few lines for the usual limit, so it is lowered."""
    return align.wide(_nodes(spark, sf_dir), 16)


@query(f"WITH {_NAMED} SELECT doc_id, CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^.+\\.[^.]*$') THEN regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1) END AS extension FROM named")
def path_extension(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", paths.extension(F.col("path")).alias("extension"))


_TEXTY = f"regexp_extract(path, '[^/]*$') IN {paths.TEXT_NAMES} OR regexp_matches(regexp_extract(path, '[^/]*$'), '^\\..*ignore$') OR string_split(path, '.')[-1] IN {paths.TEXT_EXTENSIONS}"


@query(f"WITH {_NAMED} SELECT doc_id, ({_LANG}) IS NULL AND ({_TEXTY}) AS text_only FROM named")
def text_only_paths(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", paths.is_text_only(F.col("path")).alias("text_only"))


@query(f"""WITH {_NAMED}, given AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(path, '/', chr(92)) WHEN 1 THEN '../' || path WHEN 2 THEN replace(path, '/', '/../') ELSE path END AS path FROM named)
    SELECT doc_id, CASE WHEN NOT list_contains(string_split(replace(path, chr(92), '/'), '/'), '..') THEN replace(path, chr(92), '/') END AS path FROM given""")
def normalized_path(spark, sf_dir):
    """Back slashes in a quarter of the paths, steps up in half of them."""
    by, path = F.col("doc_id") % 4, F.col("path")
    given = F.when(by == 0, F.regexp_replace(path, "/", "\\\\")).when(by == 1, F.concat(F.lit("../"), path)).when(by == 2, F.regexp_replace(path, "/", "/../")).otherwise(path)
    return _named(spark, sf_dir).withColumn("path", given).select("doc_id", paths.normalized(F.col("path")).alias("path"))


_IDS = "given AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(source || doc_id) WHEN 1 THEN upper(sha256(source || doc_id)) WHEN 2 THEN substr(sha256(source || doc_id), 2) ELSE 'g' || substr(sha256(source || doc_id), 2) END AS id FROM documents)"


@query(f"WITH {_IDS} SELECT doc_id, length(id) = 64 AND regexp_full_match(lower(id), '[0-9a-f]*') AS is_id, substr(id, 1, 12) AS short FROM given")
def state_ids(spark, sf_dir):
    """Ids in both cases, too short ones and such that are no hexadecimal."""
    whole, by = hashing.text_hash(F.concat("source", "doc_id")), F.col("doc_id") % 4
    made = F.when(by == 0, whole).when(by == 1, F.upper(whole)).when(by == 2, F.substring(whole, 2, 64)).otherwise(F.concat(F.lit("g"), F.substring(whole, 2, 64)))
    return d.read(spark, sf_dir, "documents").select("doc_id", made.alias("id")).select("doc_id", hashing.is_state_id(F.col("id")).alias("is_id"), hashing.short_id(F.col("id")).alias("short"))


@query("""WITH q AS (SELECT event_id, '?user=' || user_id || '&kind=' || event_type || '&flag&=x&user=' || (user_id + 1) || CASE WHEN event_id % 2 = 0 THEN '&a=b=c' ELSE '' END AS q FROM events),
    parts AS (SELECT event_id, unnest(string_split(substr(q, 2), '&')) AS part, generate_subscripts(string_split(substr(q, 2), '&'), 1) AS i FROM q),
    named AS (SELECT event_id, i, string_split(part, '=')[1] AS name, CASE WHEN contains(part, '=') THEN substr(part, instr(part, '=') + 1) ELSE '' END AS value FROM parts WHERE part <> '' AND part[1] <> '=')
    SELECT event_id, name, arg_max(value, i) AS value FROM named GROUP BY event_id, name""")
def query_parameters(spark, sf_dir):
    """A name alone, a value without a name, a name twice and a value with an equals sign."""
    user = F.col("user_id")
    text = F.concat(F.lit("?user="), user, F.lit("&kind="), F.col("event_type"), F.lit("&flag&=x&user="), user + 1, F.when(F.col("event_id") % 2 == 0, "&a=b=c").otherwise(""))
    return d.read(spark, sf_dir, "events").select("event_id", F.explode(paths.query_parameters(text)).alias("name", "value"))


@query("SELECT event_id, CASE WHEN event_id % 100 >= user_id % 200 THEN 1 ELSE floor(log2(user_id % 200 - event_id % 100)) + 1 END::INTEGER AS steps FROM events")
def bisect_steps(spark, sf_dir):
    return d.read(spark, sf_dir, "events").select("event_id", paths.bisect_steps(F.col("event_id") % 100, F.col("user_id") % 200).alias("steps"))


@query(_TWO + _RENAMES.format(n="", s="side") + """, moved AS (SELECT from_path AS path FROM ren UNION SELECT to_path FROM ren)
    SELECT 0::INTEGER AS seq, 'renamed' AS change, from_path AS path, to_path FROM ren UNION ALL
    SELECT 1, CASE WHEN b.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed' WHEN b.blob <> s.blob THEN 'modified' ELSE 'mode' END, coalesce(b.path, s.path), NULL
    FROM base b FULL JOIN side s ON s.path = b.path WHERE (b.path IS NULL OR s.path IS NULL OR b.blob <> s.blob OR b.mode <> s.mode) AND coalesce(b.path, s.path) NOT IN (SELECT path FROM moved)""")
def state_diff(spark, sf_dir):
    base, left, _ = _sides(spark, sf_dir)
    return listing.state_diff(base, left)


_DID = "CASE WHEN b_blob IS NULL AND {s}_blob IS NOT NULL THEN 'added' WHEN b_blob IS NOT NULL AND {s}_blob IS NULL THEN 'removed' WHEN b_blob <> {s}_blob OR b_mode <> {s}_mode THEN 'modified' END"


@query(f"""{_THREE}, did AS (SELECT path, {_DID.format(s="l")} AS "left", {_DID.format(s="r")} AS "right" FROM three) SELECT * FROM did WHERE "left" IS NOT NULL OR "right" IS NOT NULL""")
def three_way_listing(spark, sf_dir):
    return listing.three_way_listing(*_sides(spark, sf_dir))


@query(f"WITH base AS ({d.MANIFESTS_SQL['base']}), s AS (SELECT min(split_part(path, '/', 1)) AS low, max(split_part(path, '/', 1)) AS high, min(path) AS file FROM base) SELECT path FROM base, s WHERE starts_with(path, low || '/') OR path = file OR starts_with(path, high || '/')")
def matching_paths(spark, sf_dir):
    """Two folders, one with a slash at its end, and one file."""
    base = d.manifest(spark, sf_dir, "base")
    folder = F.substring_index("path", "/", 1)
    specs = base.agg(F.min(folder).alias("low"), F.max(folder).alias("high"), F.min("path").alias("file")).first()
    return listing.matching(base, [specs["low"], f"{specs['high']}/", specs["file"]]).select("path")


@query(_WALK + _CLOSURE.format(n="c", tip=_FROM) + " SELECT state, min(depth)::INTEGER AS depth FROM c GROUP BY state HAVING min(depth) <= 20")
def limited_ancestry(spark, sf_dir):
    return history.closure(d.commit_edges(spark, sf_dir), _newest(spark, sf_dir, _FROM)).where("depth <= 20").select("state", "depth")


@query(_WALK + _CLOSURE.format(n="c", tip=_FROM) + f" SELECT count(*) > 0 AS fast_forward FROM branches WHERE name = '{_OTHER}' AND state IN (SELECT state FROM c)")
def fast_forward(spark, sf_dir):
    return sync.fast_forward(d.commit_edges(spark, sf_dir), _newest(spark, sf_dir, _FROM), _newest(spark, sf_dir, _OTHER))


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS blob, octet_length(encode(coalesce(text, '')))::BIGINT AS size, true AS same FROM documents")
def pack_roundtrip(spark, sf_dir):
    """All documents packed, unpacked and hashed again."""
    text = F.coalesce("text", F.lit(""))
    blobs = d.read(spark, sf_dir, "documents").select(hashing.text_hash(text).alias("blob"), text.cast("binary").alias("bytes"))
    return packs.verified(packs.unpack(packs.pack(blobs)))
