"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from .tables import QUERIES as ASKED

L = """l AS (SELECT *, l_extendedprice * (1 - l_discount) AS price,
  l_extendedprice * (1 - l_discount) / l_quantity AS unit, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""
#: A part name's family and form.
FAMILY = """CASE WHEN {n} IN ('widget', 'gizmo') THEN 'gadget' WHEN {n} IN ('bolt', 'rod', 'ring') THEN 'fastener'
  WHEN {n} = 'plate' THEN 'plate' WHEN {n} IN ('anvil', 'gear') THEN 'tool' END"""
NOUN = FAMILY.format(n="split_part(p_name, ' ', 2)")
FORM = "CASE WHEN split_part(p_name, ' ', 1) IN ('hot', 'cold') THEN split_part(p_name, ' ', 1) END"


def _text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_text(v) for v in r) + ")" for r in rows)


def _variants(word: str) -> list[str]:
    return {"rod": ["rod", "bar"], "big": ["large", "big"]}.get(word, [word])


def _asked_row(query_id: int, query: str) -> tuple:
    ws = query.split()
    nouns = {"bolt": "fastener", "rod": "fastener", "ring": "fastener", "gear": "tool", "gizmo": "gadget"}
    form = next((w for w in ws if w in ("hot", "cold")), None)
    family = next((nouns[w] for w in ws if w in nouns), None)
    return query_id, len(ws), "|".join(_variants(ws[0])), "|".join(_variants(ws[1])) if len(ws) > 1 else None, family, form


#: Queries by the parts that have a word of theirs: words found (m of n), whether in
#: order, and stages by rule.
_STAGED = f"""asked(query_id, n, v1, v2, qfam, qform) AS (VALUES {_values([_asked_row(*a) for a in ASKED])}),
parts AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, {NOUN} AS fam, {FORM} AS form FROM part),
met AS (
  SELECT *, list_contains(string_split(v1, '|'), a) AS a1, list_contains(string_split(v1, '|'), b) AS b1,
    coalesce(list_contains(string_split(v2, '|'), a), false) AS a2, coalesce(list_contains(string_split(v2, '|'), b), false) AS b2
  FROM parts, asked),
staged AS (
  SELECT *, CASE
    WHEN n = 1 THEN CASE WHEN NOT (a1 OR b1) THEN 0 WHEN qfam <> fam THEN 1
      WHEN CASE WHEN a = 'new' THEN b1 ELSE a1 END THEN 5 ELSE 4 END
    WHEN NOT ((a1 OR b1) AND (a2 OR b2)) THEN CASE WHEN a1 OR b1 OR a2 OR b2 THEN 1 ELSE 0 END
    WHEN qfam <> fam THEN 1 WHEN a1 AND b2 THEN 5 ELSE 4 END AS stage
  FROM met WHERE a1 OR b1 OR a2 OR b2)"""
STAGES = _STAGED + """,
scored AS (
  SELECT *, CASE WHEN n = 1 THEN CASE WHEN a1 OR b1 THEN 100.0 ELSE 0.0 END
    ELSE (CASE WHEN a1 OR b1 THEN 100 ELSE 0 END + CASE WHEN a2 OR b2 THEN 100 ELSE 0 END) / 2.0
      * (0.5 + 0.5 * (CAST(a1 OR b1 AS INT) + CAST(a2 OR b2 AS INT)) / 2.0) END AS rel
  FROM staged)"""


def ladder(one_word_band: str, infer: bool, never_empty: bool, source: str = "scored") -> str:
    band = "CASE WHEN stage >= 4 THEN 4 ELSE stage END" if one_word_band == "primary" else "stage"
    target = "coalesce(qfam, CASE WHEN top.n >= 2 AND top.n * 2 > top.known THEN top.fam END)" if infer else "qfam"
    applied = lambda c: f"sum(CAST({c} AS INT)) OVER (PARTITION BY query_id) > 0" if never_empty else "true"
    return f"""WITH {STAGES},
competing AS (SELECT * FROM scored WHERE rel >= 30 AND (n = 1 OR ((a1 OR b1) AND (a2 OR b2)))),
banded AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN stage >= 2 THEN 2 ELSE stage END ELSE {band} END AS band FROM {source}),
g1 AS (SELECT *, band = max(band) OVER (PARTITION BY query_id) AS in1 FROM banded),
fams AS (SELECT query_id, fam, count(*) AS n, min(p_partkey) AS first, sum(count(*)) OVER (PARTITION BY query_id) AS known
  FROM g1 WHERE in1 AND fam IS NOT NULL GROUP BY query_id, fam),
top AS (SELECT * FROM fams QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) = 1),
g2 AS (SELECT g1.*, {target} AS target FROM g1 LEFT JOIN top USING (query_id)),
g3 AS (SELECT *, in1 AND coalesce(fam = target, true) AS ok2 FROM g2),
g4 AS (SELECT *, in1 AND (ok2 OR NOT ({applied('ok2')})) AS in2 FROM g3),
g5 AS (SELECT *, in2 AND (qform IS NULL OR coalesce(form = qform, true)) AS ok3 FROM g4),
g6 AS (SELECT *, in2 AND (ok3 OR NOT ({applied('ok3')})) AS in3 FROM g5)"""


def _counts(*policy) -> str:
    return f"""{ladder(*policy)}
SELECT query_id, count(*) FILTER (WHERE in3) AS kept, count(*) FILTER (WHERE NOT in1) AS stage_excluded,
  count(*) FILTER (WHERE in1 AND NOT in2) AS family_excluded, count(*) FILTER (WHERE in2 AND NOT in3) AS form_excluded,
  CAST(0 AS BIGINT) AS fresh_excluded, max(target) AS target_family
FROM g6 GROUP BY query_id"""


def _ranked(keys: str) -> str:
    return f"""{ladder('exact', True, True)},
kinds AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'kg' ELSE 'pc' END AS unit, p_retailprice / p_size AS unit_value,
  CASE WHEN qfam IS NOT NULL THEN CASE WHEN fam = qfam THEN 3 WHEN fam IS NULL THEN 2 ELSE 0 END
    WHEN rel >= 75 THEN 2 WHEN rel >= 45 THEN 1 ELSE 0 END AS fband,
  CASE WHEN p_brand = 'Brand#1' THEN 1.0::DOUBLE ELSE 0 END + least(p_partkey % 10 / 20::DOUBLE, 0.5) * 1.2::DOUBLE
    + least(1.5::DOUBLE, least(p_partkey % 7, 20) / 20::DOUBLE * 0.75::DOUBLE) AS featured FROM g6),
units AS (SELECT query_id, unit, count(*) AS c, min(p_partkey) AS first FROM kinds GROUP BY ALL),
chosen AS (SELECT query_id, unit AS dominant FROM units QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, first) = 1),
keyed AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN stage >= 2 THEN 2 ELSE stage END WHEN stage >= 4 THEN 4 ELSE stage END AS top_band
  FROM kinds JOIN chosen USING (query_id)),
judged AS (SELECT *, top_band >= CASE WHEN n > 1 THEN 2 ELSE 4 END AND (qfam IS NULL OR fband >= 2) AS genuine, unit = dominant AS inside FROM keyed)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {keys}, p_retailprice, rel DESC, p_partkey) AS INT) AS rank, p_partkey
FROM judged QUALIFY rank <= 20"""


ORDERED = "PARTITION BY l_partkey ORDER BY day, l_orderkey, l_linenumber, l_suppkey"
MEDIAN = "list_sort(list({v}))[CAST(floor(count(*) / 2) AS INT) + 1]"
#: Letters folded, then all but letters, digits and blanks to blanks, collapsed.
NORMAL = r"""trim(regexp_replace(regexp_replace(translate(lower(coalesce({t}, '')), 'أإآٱىؤئةیک', 'اااايويهيك'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"""

def greedy(rows: str, columns: str, alike: str) -> str:
    """``rows`` (block, ord, ``columns``) one after the other, each against the leaders
    ``k`` before it."""
    names = [c.split()[0] for c in columns.split(", ")]
    return f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY ord) AS i FROM ({rows})),
r AS (SELECT block, 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::BIGINT AS leader, []::STRUCT(ord BIGINT, {columns})[] AS led FROM n GROUP BY block
  UNION ALL
  SELECT block, i, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(led, {{'ord': ord, {", ".join(f"'{c}': {c}" for c in names)}}}) ELSE led END
  FROM (SELECT n.*, r.led, list_filter(r.led, lambda k: {alike})[1].ord AS hit FROM r JOIN n ON n.block = r.block AND n.i = r.i + 1))"""


EQUIVALENT = greedy(
    "SELECT {block} AS block, p_partkey AS ord, {total} AS total, " + FORM + " AS form, {brand} AS brand, list_distinct(string_split(p_name, ' ')) AS words FROM part",
    "total DOUBLE, form VARCHAR, brand VARCHAR, words VARCHAR[]",
    """abs(k.total - n.total) <= 0.03 * greatest(k.total, n.total) AND coalesce(k.form = n.form, true)
    AND CASE WHEN k.brand <> '' AND n.brand <> '' THEN k.brand = n.brand ELSE len(list_intersect(k.words, n.words)) >= 0.6 * greatest(len(k.words), len(n.words)) END""",
) + " SELECT block, ord AS p_partkey, leader AS representative FROM r WHERE i > 0"


def _equivalent(block: str, total: str, brand: str) -> str:
    return EQUIVALENT.replace("{block}", block).replace("{total}", total).replace("{brand}", brand)


SQL = {
    "dedupe_jaccard": greedy(
        "SELECT p_brand || '|' || CAST(floor(p_retailprice / 10) AS VARCHAR) AS block, p_partkey AS ord, list_distinct(string_split(p_name, ' ')) AS words FROM part", "words VARCHAR[]",
        "len(list_intersect(k.words, n.words)) >= 0.7 * len(list_distinct(list_concat(k.words, n.words)))",
    ) + " SELECT ord AS p_partkey FROM r WHERE i > 0 AND leader = ord",
    "group_equivalents": _equivalent("p_brand", "p_size::DOUBLE", "''"),
    "group_branded": _equivalent("p_type", "p_size * CASE WHEN p_partkey % 3 = 0 THEN 1.02::DOUBLE ELSE 1.0::DOUBLE END", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END"),
    "best_value": f"""WITH {L},
m AS (SELECT l_partkey, count(*) AS n, {MEDIAN.format(v='unit')} AS med FROM l GROUP BY l_partkey HAVING count(*) >= 2),
k AS (SELECT l.*, m.n, unit <= med * 6 AND unit >= med / 6 AS ok FROM l JOIN m USING (l_partkey)),
c AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY l_partkey) AS kept FROM k)
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, unit AS best_unit,
  CAST(CASE WHEN kept >= 2 THEN kept ELSE n END AS BIGINT) AS pool, CAST(n - CASE WHEN kept >= 2 THEN kept ELSE n END AS BIGINT) AS dropped
FROM c WHERE ok OR kept < 2
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY unit, l_orderkey, l_linenumber, l_suppkey) = 1""",
    "cheapest_per_store": f"""WITH {L} SELECT l_partkey, l_suppkey, price, l_orderkey, l_linenumber FROM l
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY price, l_orderkey, l_linenumber) = 1""",
    "price_range_summary": f"""WITH {L} SELECT l_partkey, min(price) AS lowest, max(price) AS highest,
  count(DISTINCT l_suppkey) AS stores, count(*) AS listings FROM l GROUP BY l_partkey""",
    "unit_outliers": f"""WITH {L}, m AS (SELECT l_suppkey, {MEDIAN.format(v='unit')} AS med FROM l GROUP BY l_suppkey HAVING count(*) >= 3)
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, unit FROM l JOIN m USING (l_suppkey) WHERE unit > med * 6 OR unit < med / 6""",
    "median_price_penalty": f"""WITH {L},
m AS (SELECT l_partkey, CASE WHEN count(*) >= 4 THEN {MEDIAN.format(v='price')} END AS median FROM l GROUP BY l_partkey)
SELECT l_partkey, max(median) AS median, count(*) FILTER (WHERE abs(log2(price / median)) > 1) AS penalized,
  count(*) FILTER (WHERE (abs(log2(price / median)) - 1) * 1.6 >= 2.5) AS capped FROM l JOIN m USING (l_partkey) GROUP BY l_partkey""",
    "discount_bands": f"""WITH {L}, p AS (SELECT l_suppkey, CASE WHEN l_extendedprice > price AND l_extendedprice > 0
  THEN (l_extendedprice - price) / l_extendedprice * 100 END AS pct FROM l)
SELECT l_suppkey, CASE WHEN pct IS NULL THEN 'none' WHEN pct < 15 THEN 'low' WHEN pct <= 45 THEN 'mid' ELSE 'high' END AS state, count(*) AS listings
FROM p GROUP BY ALL""",
    "dominant_kind": """SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) = 1""",
    "normalize_text": f"SELECT doc_id, md5({NORMAL.format(t='text')}) AS digest FROM documents",
    "token_inventory": f"""WITH t AS (SELECT doc_id, list_filter(string_split({NORMAL.format(t='text')}, ' '),
  lambda w: length(w) > 1 OR regexp_matches(w, '\\p{{N}}')) AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct FROM t""",
    "synonym_expand": """SELECT p_partkey, unnest(flatten(list_transform(string_split(p_name, ' '), lambda w:
  CASE WHEN w IN ('rod', 'bar') THEN ['rod', 'bar'] WHEN w IN ('large', 'big') THEN ['large', 'big'] ELSE [w] END))) AS word FROM part""",
    "family_tiers": f"SELECT p_partkey, {NOUN} AS family FROM part",
    "form_keyword": f"SELECT p_partkey, {FORM} AS form FROM part",
    "parse_sizes": """SELECT p_partkey, 'ml' AS unit, 250.0::DOUBLE AS each, p_size AS pack, 250.0::DOUBLE * p_size AS total, 'measure' AS src,
  CASE WHEN p_size > 1 THEN p_size || ' × 250 ml' ELSE '250 ml' END AS label FROM part""",
    "unit_price": "SELECT p_partkey, p_retailprice / (p_size * 250.0::DOUBLE / 1000) AS unit_value, 'L' AS per FROM part",
    "relevance_score": f"""WITH {STAGES} SELECT query_id, p_partkey, CAST(rel AS DOUBLE) AS rel, a1 OR b1 OR a2 OR b2 AS relevant,
  CASE WHEN n = 1 THEN a1 OR b1 ELSE (a1 OR b1) AND (a2 OR b2) END AS is_primary FROM scored""",
    "match_stage": f"WITH {STAGES} SELECT query_id, p_partkey, stage FROM staged",
    "gate_ladder_summary": _counts("exact", True, True),
    "gate_ladder_alert": _counts("exact", True, False),
    "gate_ladder_history": _counts("primary", False, True),
    "identity_lock": f"""{ladder('exact', True, True)},
covered AS (SELECT *, list_concat(CASE WHEN a1 OR b1 THEN [0] ELSE [] END, CASE WHEN a2 OR b2 THEN [1] ELSE [] END) AS cover FROM g6),
anchor AS (SELECT query_id, cover AS acover, p_brand AS abrand FROM covered QUALIFY row_number() OVER (PARTITION BY query_id
  ORDER BY in3 DESC, rel DESC, p_type <> 'PROMO' DESC, p_retailprice, p_partkey) = 1),
locked AS (SELECT *, in3 AND len(acover) > 0 AND p_brand <> abrand AND NOT list_has_all(cover, acover) AS out4 FROM covered JOIN anchor USING (query_id))
SELECT query_id, count(*) FILTER (WHERE in3 AND NOT out4) AS kept, count(*) FILTER (WHERE out4) AS identity_excluded FROM locked GROUP BY query_id""",
    "canonical_pull_in": """WITH r AS (SELECT l.*, p_brand FROM lineitem l JOIN part ON l_partkey = p_partkey), a AS (SELECT * FROM r WHERE l_quantity >= 49)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r
WHERE EXISTS (SELECT 1 FROM a WHERE a.l_partkey = r.l_partkey AND a.p_brand = r.p_brand)
  AND NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = r.l_orderkey AND a.l_linenumber = r.l_linenumber AND a.l_partkey = r.l_partkey AND a.l_suppkey = r.l_suppkey)""",
    "shared_best_price": f"""WITH {L},
h AS (SELECT l_partkey, price AS best, l_suppkey AS head FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY price, l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT l_partkey, count(DISTINCT l_suppkey) AS shared_with FROM l JOIN h USING (l_partkey)
WHERE l_suppkey <> head AND abs(price - best) <= 0.005::DOUBLE GROUP BY l_partkey""",
    "canonical_groups": f"""WITH {L}, r AS (SELECT *, l_partkey % 50 AS aisle FROM l JOIN part ON l_partkey = p_partkey),
h AS (SELECT aisle, l_partkey AS head FROM r QUALIFY row_number() OVER (PARTITION BY aisle ORDER BY price, l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT l_partkey, p_brand, count(DISTINCT l_suppkey) AS stores, count(*) AS listings,
  CAST(row_number() OVER (PARTITION BY aisle ORDER BY bool_or(l_partkey = head) DESC, count(DISTINCT l_suppkey) DESC, l_partkey, p_brand) AS INT) AS rank
FROM r JOIN h USING (aisle) GROUP BY aisle, l_partkey, p_brand HAVING count(DISTINCT l_suppkey) >= 2""",
    "rank_lowest_price": _ranked("genuine DESC, CASE WHEN genuine THEN NULL ELSE top_band END DESC NULLS LAST, CASE WHEN genuine THEN NULL ELSE fband END DESC NULLS LAST"),
    "rank_best_value": _ranked("stage DESC, fband DESC, inside DESC, CASE WHEN inside THEN unit_value END NULLS FIRST"),
    "rank_featured": _ranked("stage DESC, fband DESC, featured DESC"),
    "history_points": f"""WITH {L}, p AS (SELECT l_partkey, day, l_orderkey, l_linenumber, l_suppkey, CAST(floor(unit) AS BIGINT) AS price,
  lag(CAST(floor(unit) AS BIGINT)) OVER ({ORDERED}) AS previous FROM l)
SELECT * REPLACE (CAST(day AS VARCHAR) AS day, coalesce(previous, -1) AS previous) FROM p WHERE previous IS NULL OR previous <> price""",
    "history_summary": f"""WITH {L}, f AS (SELECT l_partkey, unit AS lowest, l_suppkey AS lowest_store, day AS lowest_day FROM l
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY unit, l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT l_partkey, any_value(lowest) AS lowest, any_value(lowest_store) AS lowest_store, CAST(any_value(lowest_day) AS VARCHAR) AS lowest_day, max(unit) AS highest,
  count(DISTINCT date_trunc('week', day)) AS weeks, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen, count(*) AS observations
FROM l JOIN f USING (l_partkey) GROUP BY l_partkey""",
    "history_size_join": """SELECT y.p_partkey AS b, count(*) AS alike FROM part x JOIN part y ON x.p_brand = y.p_brand
WHERE greatest(x.p_size, y.p_size)::DOUBLE - least(x.p_size, y.p_size) <= 0.03::DOUBLE * greatest(x.p_size, y.p_size) GROUP BY y.p_partkey""",
    "lowest_ever": f"""WITH {L}, r AS (SELECT *, min(unit) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before,
  count(*) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS depth FROM l)
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, unit, low_before FROM r WHERE unit <= low_before AND depth >= 4""",
    "history_verdict": f"""WITH {L},
t AS (SELECT l_partkey, unit AS today FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, unit DESC) = 1),
s AS (SELECT l_partkey, min(unit) AS low, count(DISTINCT date_trunc('week', day)) AS weeks FROM l GROUP BY l_partkey)
SELECT l_partkey, today, low, weeks, CASE WHEN weeks < 2 THEN 'building' WHEN today <= low + 1e-9 THEN 'at-low'
  WHEN (today - low) / low <= 0.1 THEN 'near-low' ELSE 'above-low' END AS verdict FROM t JOIN s USING (l_partkey)""",
    "back_on_offer": f"""WITH {L}, g AS (SELECT l_partkey, CAST(day - lag(day) OVER ({ORDERED}) AS INT) AS gap FROM l)
SELECT l_partkey, count(*) FILTER (WHERE gap >= 28) AS returns, max(gap) AS longest_gap FROM g GROUP BY l_partkey""",
    # Six signals, each judged from the offers up to the one in question. The tables have
    # no multi-buy and no advertised cut of a quarter, so two of them never give points.
    "deal_score": f"""WITH {L},
w AS (SELECT *, date_trunc('week', day) AS week, min(unit) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low,
  min(date_trunc('week', day)) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS week0 FROM l),
k AS (SELECT *, week IS DISTINCT FROM lag(week) OVER ({ORDERED}) AS fresh, CASE WHEN unit <= coalesce(low, unit) + 1e-9 THEN day END AS met FROM w),
c AS (SELECT *, sum(CAST(fresh AS INT)) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS seen, datediff('day', week0, week) // 7 + 1 AS known,
  max(met) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_met,
  CASE WHEN l_extendedprice > price THEN (l_extendedprice - price) / l_extendedprice * 100 ELSE 0 END AS cut FROM k),
s AS (SELECT *, CASE WHEN unit <= low AND seen >= 4 THEN 50 ELSE 0 END
  + CASE WHEN cut >= 40 - 1e-9 THEN 30 WHEN cut >= 25 - 1e-9 THEN 15 ELSE 0 END
  + CASE WHEN known >= 8 AND seen <= 0.25::DOUBLE * known THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(p_name, '[0-9]\\s*[+]\\s*[0-9]|(^| )free( |$)') THEN 10 ELSE 0 END
  + CASE WHEN abs(unit - low) <= 1e-9 AND datediff('day', last_met, day) >= 28 THEN 15 ELSE 0 END AS score FROM c JOIN part ON l_partkey = p_partkey)
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, score FROM s WHERE score >= 50""",
    "headline_decision": f"""WITH {L},
m AS (SELECT l_partkey, count(*) AS n, {MEDIAN.format(v='unit')} AS med FROM l GROUP BY l_partkey HAVING count(*) >= 2),
k AS (SELECT l.*, m.n, unit <= med * 6 AND unit >= med / 6 AS ok FROM l JOIN m USING (l_partkey)),
c AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY l_partkey) AS kept FROM k),
b AS (SELECT l_partkey, unit AS bu, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS bk, CASE WHEN kept >= 2 THEN kept ELSE n END AS pool FROM c WHERE ok OR kept < 2
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY unit, l_orderkey, l_linenumber, l_suppkey) = 1),
h AS (SELECT l_partkey, price AS lowest, unit AS cu, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS ck FROM l
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY price, l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT l_partkey, lowest, CASE WHEN bk IS NULL THEN 'cheapest' WHEN bk = ck THEN 'best-buy' WHEN bu <= cu * 0.9::DOUBLE THEN 'best-value' ELSE 'best-buy' END AS headline,
  CASE WHEN grouped THEN 'high' WHEN bk IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM h LEFT JOIN b USING (l_partkey)
  JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) >= 2 AS grouped FROM l GROUP BY 1) USING (l_partkey)""",
    "browse_tiles": """SELECT coalesce(r_name, 'other') AS department, coalesce(n_name, 'other') AS aisle, count(*) AS offers, count(DISTINCT l_suppkey) AS stores
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
UNION ALL SELECT coalesce(r_name, 'other'), NULL, count(*), count(DISTINCT l_suppkey)
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1
UNION ALL SELECT NULL, NULL, count(*), count(DISTINCT l_suppkey) FROM lineitem""",
    "browse_facets": f"""SELECT p_brand, count(*) AS offers, count(DISTINCT l_suppkey) AS stores, count(DISTINCT {NOUN}) AS families
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "browse_listing_page": f"""WITH {L}, r AS (SELECT coalesce(r_name, 'other') AS department, l.* FROM l JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT department, CAST(row_number() OVER (PARTITION BY department ORDER BY l_discount DESC, price, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS position,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r QUALIFY position BETWEEN 49 AND 72""",
    "brand_mining": f"""WITH {L} SELECT split_part(p_name, ' ', 1) AS lead, count(DISTINCT l_partkey) AS products, count(DISTINCT l_suppkey) AS stores
FROM l JOIN part ON l_partkey = p_partkey WHERE day > (SELECT max(day) FROM l) - 56 GROUP BY 1 HAVING products >= 4 AND stores >= 2""",
    "cart_rollup": f"""WITH {L}, r AS (SELECT o_custkey, l_suppkey, CAST(round(price * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q
  FROM l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F')
SELECT coalesce(o_custkey, -1) AS o_custkey, coalesce(l_suppkey, -1) AS l_suppkey, CAST(sum(c) AS BIGINT) AS cents, CAST(sum(q) AS BIGINT) AS items FROM r GROUP BY ROLLUP (o_custkey, l_suppkey)""",
    "watch_crossings": """WITH b AS (SELECT *, value <= 20 AS below, lag(value <= 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was
  FROM events WHERE value IS NOT NULL)
SELECT event_id, user_id, value FROM b WHERE below AND NOT coalesce(was, false)""",
    "watch_states": """WITH s AS (SELECT user_id, max(ts) AS checked, arg_max(value, ts) AS last FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'unanchored' WHEN last <= 20 + 1e-9 THEN 'deal' WHEN last <= 30 + 1e-9 THEN 'close' ELSE 'watching' END AS state,
  CASE WHEN user_id % 5 <> 0 AND epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(checked)) >= 26 * 3600 THEN 'stale' END AS reason FROM s""",
    "alert_counts": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS alerts FROM events GROUP BY user_id",
    "json_props": """SELECT event_type, count(k) AS known, CAST(sum(k) AS BIGINT) AS k_sum, max(k) AS k_max
FROM (SELECT event_type, TRY_CAST(props->>'$.k' AS INT) AS k FROM events) GROUP BY event_type""",
    "url_provenance": r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https://([^/?#]+)', 1)) AS host, regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1) AS ref FROM pages)
SELECT page_id, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'link' ELSE 'search' END AS target, nullif(ref, '') AS flyer_ref FROM h""",
    "spatial_hit": """WITH p AS (SELECT event_id AS id, user_id % 4 AS page, (event_id * 37 % 1000) / 1000::DOUBLE AS px, (event_id * 91 % 997) / 997::DOUBLE AS py FROM events),
b AS (SELECT p_partkey % 4 AS page, p_partkey AS box_id, (p_partkey * 53 % 90) / 100::DOUBLE AS x, (p_partkey * 29 % 90) / 100::DOUBLE AS y,
  ((p_partkey % 7) + 1) / 100::DOUBLE AS w, ((p_partkey % 5) + 1) / 100::DOUBLE AS h FROM part),
e AS (SELECT *, x + w / 2 - greatest(w, 0.04::DOUBLE) / 2 AS x0, y + h / 2 - greatest(h, 0.04::DOUBLE) / 2 AS y0, greatest(w, 0.04::DOUBLE) AS ww, greatest(h, 0.04::DOUBLE) AS hh FROM b),
j AS (SELECT id, p.page, box_id, px >= x AND px <= x + w AND py >= y AND py <= y + h AS direct, w * h AS area
  FROM p JOIN e ON p.page = e.page WHERE px >= x0 AND px <= x0 + ww AND py >= y0 AND py <= y0 + hh)
SELECT id, page, box_id, direct FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY direct DESC, area, box_id) = 1""",
    "recent_searches": """WITH s AS (SELECT user_id, event_type || CAST(event_id % 5 AS VARCHAR) AS query, ts, event_id FROM events),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, lower(query) ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank, query FROM d QUALIFY rank <= 8""",
    "learned_counts": """WITH c AS (SELECT user_id, TRY_CAST(props->>'$.k' AS INT) AS signal, least(count(*), 40) AS n, max(event_id) AS last
  FROM events WHERE event_type = 'click' GROUP BY ALL),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC) <= 24)
SELECT user_id, count(*) AS signals, CAST(sum(least(n, 20)) AS BIGINT) AS saturated FROM k GROUP BY user_id""",
    "offer_to_brochure": """WITH o AS (SELECT CASE WHEN l_linenumber > 3 THEN l_orderkey END AS exact, l_suppkey AS loose FROM lineitem),
i AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey),
f AS (SELECT i.o_orderkey AS e, c.k FROM o LEFT JOIN i ON exact = i.o_orderkey LEFT JOIN c ON loose = o_custkey)
SELECT CASE WHEN e IS NOT NULL THEN 1 WHEN k IS NOT NULL THEN 2 END AS matched_by, count(*) AS offers, count(DISTINCT coalesce(e, k)) AS flyers FROM f GROUP BY 1""",
    "latest_upsert": """SELECT user_id, event_type, value, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "usable_prices": """SELECT event_type, count(*) FILTER (WHERE event_id % 7 = 1 OR (event_id % 7 > 1 AND value > 0)) AS usable, count(*) AS listings
FROM events GROUP BY event_type""",
    "event_windows": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, min(value) AS low, count(*) AS n FROM events GROUP BY ALL",
}
