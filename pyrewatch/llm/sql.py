"""The same questions as SQL, where SQL can say them."""

from __future__ import annotations

from pyrewatch.llm.rules import BASE, RULES, STOP_WORDS, SYMBOLS, Rule
from pyrewatch.llm.sharding import CELL_DIGITS, tree

REPEATED_WORDS = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE len(words) >= 50)),
firsts AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place
  FROM windows JOIN firsts USING (w) WHERE first_id < doc_id),
each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
kept AS (
  SELECT e.doc_id, count(g.place) AS n_removed, string_agg(CASE WHEN g.place IS NULL THEN word END, ' ' ORDER BY e.place) AS text
  FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.place = e.place GROUP BY e.doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

TOP_PRODUCTS = """
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _draw(path: str, weight: int) -> str:
    return f"-ln((CAST('0x' || substr(md5('{path}|' || k), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r}) / {weight}.0"


def _winner(children: dict[str, int], path: str) -> str:
    if len(children) == 1:
        return f"'{next(iter(children))}'"
    draws = [f"struct_pack(draw := {_draw(f'{path}/{name}', weight)}, name := '{name}')" for name, weight in sorted(children.items())]
    return f"list_min([{', '.join(draws)}]).name"


def _levels(shards: int, prefix: str) -> tuple[str, str, str]:
    """Region, rack and shard of ``k`` in a tree of equal shards; a level reads the columns of the one above."""
    found: dict[str, dict[str, dict[str, int]]] = {}
    for leaf in tree(shards):
        found.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[str(leaf.shard)] = 1
    region = _winner({r: sum(map(len, racks.values())) for r, racks in found.items()}, "")
    rack = " ".join(f"WHEN '{r}' THEN {_winner({k: len(s) for k, s in racks.items()}, r)}" for r, racks in found.items())
    shard = " ".join(f"WHEN '{r}/{k}' THEN {_winner(s, f'{r}/{k}')}" for r, racks in found.items() for k, s in racks.items())
    return region, f"CASE {prefix}region {rack} END", f"CAST(CASE {prefix}region || '/' || {prefix}rack {shard} END AS INTEGER)"


def _crc_table() -> str:
    """The 256 remainders of a byte by the reversed polynomial of CRC-32, by eight steps of one bit."""
    table = "SELECT b, b AS c FROM (SELECT unnest(range(0, 256)) AS b)"
    for _ in range(8):
        table = f"SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END AS c FROM ({table})"
    return table


def sharding(shards: int = 8) -> str:
    region, rack, shard = _levels(shards, "")
    grown_region, grown_rack, grown_shard = _levels(shards + 1, "grown_")
    ones = (1 << 32) - 1
    return f"""
WITH steps AS (SELECT list(c ORDER BY b) AS crc FROM ({_crc_table()})),
docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null key') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents),
sums AS (
  SELECT doc_id, k, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), {ones}), {ones}) AS text_crc32
  FROM docs, steps),
regions AS (SELECT *, {region} AS region, {grown_region} AS grown_region FROM sums),
racks AS (SELECT *, {rack} AS rack, {grown_rack} AS grown_rack FROM regions),
placed AS (SELECT *, {shard} AS shard, {grown_shard} AS grown_shard FROM racks)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
  ORDER BY substr(md5(concat_ws('|', doc_id, size, text_crc32)), 1, {CELL_DIGITS}), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed
"""


def _broken(rules: tuple[Rule, ...]) -> str:
    def test(rule: Rule) -> str:
        sides = [f"100 * {rule.top} {sign} {rule.bottom or 1} * {limit}"
                 for sign, limit in (("<", rule.least), (">", rule.most)) if limit is not None]
        return f"CASE WHEN {' OR '.join(sides)} THEN '{rule.name}' END"
    return f"list_filter([{', '.join(map(test, rules))}], lambda x: x IS NOT NULL)"


def quality_rules() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) >= 3)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows),
covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS place FROM counted WHERE n > 1) GROUP BY r),
found AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_shouts,
    CAST(len(list_filter(words, lambda w: list_contains([{stops}], lower(w)))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS BIGINT) AS n_cut_lines,
    CAST(len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•‣]'))) AS BIGINT) AS n_listed_lines
  FROM docs LEFT JOIN covered c USING (r)),
judged AS (SELECT *, {_broken(BASE)} AS base, {_broken(RULES)} AS own FROM found)
SELECT * EXCLUDE (base, own), len(base) > 0 AS base_failed, len(base) = 0 AND len(own) = 0 AS kept,
  array_to_string(list_concat(base, own), ', ') AS broken_rules FROM judged
"""


def lloyd(centroids: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3, largest: int = 1 << 27) -> str:
    def nearest(n: int) -> str:
        apart = "list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
        return f"""
a{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := CAST(list_sum({apart}) AS BIGINT), c := cluster)) AS best FROM vectors, c{n} GROUP BY r)"""

    def moved(n: int) -> str:
        return f"""
s{n} AS (
  SELECT best.c AS cluster, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n
  FROM a{n} JOIN vectors USING (r), range(1, {dimensions + 1}) AS t(i) GROUP BY ALL),
u{n} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM s{n} GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(moved, m) AS m FROM c{n} LEFT JOIN u{n} USING (cluster))"""

    steps = ",".join(f"{nearest(n)},{moved(n)}" for n in range(rounds))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x:
    CAST(greatest(least(floor({scale} * CAST(x AS DOUBLE)), {largest}), -{largest}) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INTEGER) AS cluster, q AS m
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM vectors ORDER BY h NULLS LAST, q LIMIT {centroids})),{steps},{nearest(rounds)}
SELECT vec_id, best.c AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN vectors USING (r) JOIN c{rounds} ON c{rounds}.cluster = best.c
"""


_NEVER = 10 ** 12


def _way(state: str, cost: str, letter: str) -> str:
    return f"struct_pack(c := {state}.c + {cost}, w := {state}.w || '{letter}')"


def _cheapest(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def conversation_repair() -> str:
    def kept(state: str, initial: str) -> str:
        return _way(state, f"extra + CASE WHEN initial = '{initial}' THEN 0 ELSE {_NEVER} END", "K")

    ones, before_user = (1 << 32) - 1, ("none", "s", "a")
    arrived = {
        "none1": _way("none", "4", "D"), "s1": _cheapest(_way("s", "4", "D"), kept("none", "s")),
        "u1": _cheapest(_way("u", "4", "D"), *[kept(x, "u") for x in before_user], *[_way(x, "extra + 3", "R") for x in before_user]),
        "a1": _cheapest(_way("a", "4", "D"), kept("u", "a"), _way("u", "extra + 3", "R"))}
    user = _cheapest("u1", *[_way(x, "3", "I") for x in ("none1", "s1", "a1")])
    return rf"""
WITH RECURSIVE steps AS (SELECT list(c ORDER BY b) AS crc FROM ({_crc_table()})),
keyed AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
      lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM conversations),
kinds AS (SELECT * EXCLUDE (bytes), xor(list_reduce(bytes, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), {ones}), {ones}) % 20 AS kind FROM keyed, steps),
damaged AS (
  SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
seen AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY pos) AS nth,
    lag(initial) OVER (PARTITION BY k ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM ordered),
rows AS MATERIALIZED (
  SELECT *, NOT blank AND nth > 1 AS repeated,
    NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut,
    CASE WHEN blank OR nth > 1 THEN {_NEVER} WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS extra
  FROM seen),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS pos, struct_pack(c := CAST(0 AS BIGINT), w := '') AS none, struct_pack(c := CAST({_NEVER} AS BIGINT), w := '') AS s,
    struct_pack(c := CAST(3 AS BIGINT), w := 'I') AS u, struct_pack(c := CAST(6 AS BIGINT), w := 'II') AS a
  FROM (SELECT DISTINCT k FROM keyed)
  UNION ALL
  SELECT k, pos, none1, s1, u2, {_cheapest("a1", _way("u2", "3", "I"))} FROM (
    SELECT *, {user} AS u2 FROM (
      SELECT w.k, r.pos, {', '.join(f'{way} AS {name}' for name, way in arrived.items())}
      FROM walk w JOIN rows r ON r.k = w.k AND r.pos = w.pos + 1))),
ends AS MATERIALIZED (SELECT k, {_cheapest("arg_max(none, pos)", "arg_max(a, pos)")} AS best FROM walk GROUP BY k),
letters AS (
  SELECT k, i, audit[i] AS letter FROM (SELECT k, best.w AS audit, unnest(range(1, length(best.w) + 1)) AS i FROM ends)),
edits AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY k ORDER BY i) AS pos,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY k ORDER BY i) AS place
  FROM letters),
made AS (
  SELECT e.*, r.role, CASE letter WHEN 'I' THEN '' ELSE r.text END AS text,
    bool_or(letter = 'K' AND place = 1 AND initial = 's') OVER (PARTITION BY e.k) AS led
  FROM edits e LEFT JOIN rows r ON r.k = e.k AND r.pos = e.pos),
lines AS (
  SELECT k, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place + CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY i) AS text
  FROM made WHERE letter <> 'D' GROUP BY k),
counts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (repeated) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.w AS audit,
  sha256(coalesce(l.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM keyed) c JOIN ends USING (k) LEFT JOIN counts USING (k) LEFT JOIN lines l USING (k)
"""
