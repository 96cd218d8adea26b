"""Views derived from the driver tables, as SQL text both engines can run.

``RX`` gives integers; ``RAW`` renders them as the text rows an operator has
to parse, with faults injected by key, so a check computed from the integers
is independent of the parser.
"""

from ionforge.session import balanced, dealt

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SYSTEM = """CASE WHEN {0} BETWEEN 1 AND 2 THEN 'triclinic' WHEN {0} BETWEEN 3 AND 15 THEN 'monoclinic'
 WHEN {0} BETWEEN 16 AND 74 THEN 'orthorhombic' WHEN {0} BETWEEN 75 AND 142 THEN 'tetragonal'
 WHEN {0} BETWEEN 143 AND 167 THEN 'trigonal' WHEN {0} BETWEEN 168 AND 194 THEN 'hexagonal'
 WHEN {0} BETWEEN 195 AND 230 THEN 'cubic' END"""

# One reaction per order: customers in threes share a host Fe_a(PO4)_b, ions by order key.
RX = """SELECT k, k + 1 AS f, c, q, a, b, m, mv, sg_c, sg_d, CASE CAST(k % 12 AS INT) WHEN 5 THEN 'Na' WHEN 6 THEN 'K'
  WHEN 7 THEN 'Mg' WHEN 8 THEN 'Ca' WHEN 9 THEN 'Zn' WHEN 10 THEN 'Al' WHEN 11 THEN 'Y' ELSE 'Li' END AS ion
FROM (SELECT k, c, q, 1 + q % 37 AS a, 1 + CAST((q - q % 37) / 37 AS BIGINT) AS b, 1 + (k + c) % 3 AS m,
  CAST(1 + (q * 7) % 230 AS INT) AS sg_c, CAST(1 + (k * 11) % 230 AS INT) AS sg_d, mv
  FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST((o_custkey - o_custkey % 3) / 3 AS BIGINT) AS q,
        CAST(round(o_totalprice) AS BIGINT) % 12000 - 1500 AS mv FROM orders) s1) s2"""

_MICRO = "CAST(round(CAST(m AS DOUBLE) * 100000000 / (m + a + 5 * b)) AS BIGINT)"
_VOLT = ("concat(CASE WHEN mv < 0 THEN '-' ELSE '' END, CAST(CAST((abs(mv) - abs(mv) % 1000) / 1000 AS BIGINT) AS STRING), "
         "'.', lpad(CAST(abs(mv) % 1000 AS STRING), 3, '0'))")

# Fault-free text reactions.
CLEAN = f"""SELECT k, concat('rec', c) AS record_key, CAST(k AS STRING) AS interval_index, ion AS working_ion,
  concat('Fe', a, '(PO4)', b) AS framework_formula, concat('Fe', a, '(PO4)', b) AS formula_charge,
  concat(ion, m, 'Fe', a, '[P(O2)2]', b) AS formula_discharge,
  concat('mp-c', q) AS id_charge, concat('mp-d', k) AS id_discharge,
  '0' AS fracA_charge, concat('0.', lpad(CAST({_MICRO} AS STRING), 8, '0')) AS fracA_discharge,
  {_VOLT} AS average_voltage_V, CAST(mv AS DOUBLE) / 1000 AS label,
  {SYSTEM.format('sg_c')} AS crystal_system_charge, {SYSTEM.format('sg_d')} AS crystal_system_discharge,
  CAST(sg_c AS STRING) AS spacegroup_number_charge, CAST(sg_d AS STRING) AS spacegroup_number_discharge
FROM rx"""

# Text reactions with one injected fault per residue class; every row is kept.
RAW = f"""SELECT k AS source_row, CASE WHEN f % 83 = 0 THEN '' ELSE concat('rec', c) END AS record_key,
  CASE WHEN f % 13 = 0 THEN '' ELSE concat('bat-', k) END AS battery_id,
  CASE WHEN f % 53 = 0 THEN 'overall' ELSE 'adjacent' END AS row_type,
  CASE WHEN f % 43 = 0 THEN concat('x', k) ELSE CAST(k AS STRING) END AS interval_index,
  CASE WHEN f % 47 = 0 THEN 'Rb' ELSE ion END AS working_ion,
  CASE WHEN f % 17 = 0 THEN 'Co1O3' ELSE concat('Fe', a, '(PO4)', b) END AS framework_formula,
  CASE WHEN f % 71 = 0 THEN concat(ion, m + 1, 'Fe', a, '(PO4)', b) ELSE concat('Fe', a, '(PO4)', b) END AS formula_charge,
  CASE WHEN f % 23 = 0 THEN 'Fe(OH' ELSE concat(ion, m, 'Fe', a, '[P(O2)2]', b) END AS formula_discharge,
  CASE WHEN f % 71 = 0 THEN concat('mp-x', k) ELSE concat('mp-c', q) END AS id_charge,
  CASE WHEN f % 61 = 0 THEN '' ELSE concat('mp-d', k) END AS id_discharge,
  '0' AS fracA_charge,
  CASE WHEN f % 31 = 0 THEN '0.9' WHEN f % 59 = 0 THEN 'nan' ELSE concat('0.', lpad(CAST({_MICRO} AS STRING), 8, '0')) END AS fracA_discharge,
  CASE WHEN f % 29 = 0 THEN '' ELSE {_VOLT} END AS average_voltage_V,
  {SYSTEM.format('sg_c')} AS crystal_system_charge,
  CASE WHEN f % 41 = 0 THEN '' WHEN f % 37 = 0 THEN ' Cubic ' ELSE {SYSTEM.format('sg_d')} END AS crystal_system_discharge,
  CAST(sg_c AS STRING) AS spacegroup_number_charge,
  CASE WHEN f % 19 = 0 THEN '0' ELSE CAST(sg_d AS STRING) END AS spacegroup_number_discharge,
  CASE WHEN f % 73 = 0 THEN 'missing_formula_charge' ELSE '' END AS issues,
  CASE WHEN f % 67 = 0 THEN 'source:abc;other;deprecated_material_charge' ELSE '' END AS warnings
FROM rx"""


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over_orders(spark, sf_dir, body):
    """Run a view over ``rx`` without touching the session catalog."""
    return spark.sql(f"WITH orders AS (SELECT * FROM {{o}}), rx AS ({RX}) {body}", o=dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")))


def rx(spark, sf_dir):
    return _over_orders(spark, sf_dir, "SELECT * FROM rx")


def clean(spark, sf_dir):
    return _over_orders(spark, sf_dir, CLEAN)


def raw(spark, sf_dir):
    return _over_orders(spark, sf_dir, RAW)


# Oracle prefix: the same views plus integer-side answers.
WITH = f"WITH RECURSIVE rx AS ({RX}), clean AS ({CLEAN}), raw AS ({RAW})"


def composition_text(count, fe="a", o="4 * b", p="b"):
    """SQL text of the sorted composition of Fe, O, P and ``count`` working ions."""
    return (f"concat(CASE WHEN ion IN ('Al','Ca') THEN concat(ion, ':', {count}, '|') ELSE '' END, 'Fe:', {fe}, "
            f"CASE WHEN ion IN ('K','Li','Mg','Na') THEN concat('|', ion, ':', {count}) ELSE '' END, '|O:', {o}, '|P:', {p}, "
            f"CASE WHEN ion IN ('Y','Zn') THEN concat('|', ion, ':', {count}) ELSE '' END)")


HOST_TEXT = "concat('Fe:', a // gcd(a, b), '|O:', 4 * b // gcd(a, b), '|P:', b // gcd(a, b))"

_BOTH, _RB = "f % 23 <> 0", "f % 47 = 0"
_NAN = "(f % 59 = 0 AND f % 31 <> 0)"
# (code, integer-side predicate) of every per-row validation rule, in rule order.
RULE_FACTS = (
    ("unsupported_working_ion", _RB), ("row_is_not_an_adjacent_interval", "f % 53 = 0"),
    ("missing_source_record_key", "f % 83 = 0"), ("invalid_interval_index", "f % 43 = 0"),
    ("unresolved_step3_issue", "f % 73 = 0"),
    ("formula_fraction_mismatch_charge", f"f % 71 = 0 AND NOT {_RB}"),
    ("missing_endpoint_id_discharge", "f % 61 = 0"), ("invalid_fraction_discharge", _NAN),
    ("unsupported_or_invalid_formula_discharge", "f % 23 = 0"),
    ("formula_fraction_mismatch_discharge", f"{_BOTH} AND (f % 31 = 0 OR ({_RB} AND NOT {_NAN}))"),
    ("host_composition_changed", f"{_BOTH} AND {_RB}"),
    ("framework_composition_mismatch", f"{_BOTH} AND NOT {_RB} AND f % 17 = 0"),
    ("non_increasing_ion_loading", f"{_BOTH} AND ({_RB} OR f % 71 = 0)"),
)
SYMMETRY_FACTS = (
    ("missing_symmetry_discharge", "f % 41 = 0"), ("invalid_spacegroup_discharge", "f % 41 <> 0 AND f % 19 = 0"),
    ("spacegroup_crystal_system_mismatch_discharge", "f % 41 <> 0 AND f % 19 <> 0 AND f % 37 = 0 AND sg_d < 195"),
)
REVIEW_FACTS = (
    ("battery_id_absent_using_record_key", "f % 13 = 0"), ("deprecated_material_charge", "f % 67 = 0"),
    ("negative_voltage", "f % 29 <> 0 AND mv < 0"), ("priority_voltage_review", "f % 29 <> 0 AND mv > 10000"),
    ("source:abc", "f % 67 = 0"),
)


def fact_text(facts):
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in facts) + ")"


def fact_any(facts):
    return "(" + " OR ".join(f"({test})" for _, test in facts) + ")"


LABEL_FACT = (("invalid_voltage_label", "f % 29 = 0"),)
ALL_FACTS = RULE_FACTS + SYMMETRY_FACTS + LABEL_FACT

_UID = "sha256(concat('[\"', r.record_key, '\",\"', r.interval_index, '\"]'))"
# Validated and grouped rows from the integers: identity, verdicts, component.
GROUPED = f"""v AS (SELECT rx.*, r.record_key, r.interval_index, r.id_charge, r.id_discharge, r.working_ion, r.source_row,
  {_UID} AS row_uid, NOT {fact_any(ALL_FACTS)} AS eligible, {fact_text(ALL_FACTS)} AS problems,
  CASE WHEN {_BOTH} AND NOT {_RB} AND f % 17 <> 0 THEN {HOST_TEXT} ELSE '' END AS canonical_host
  FROM rx JOIN raw r ON r.source_row = rx.k),
grouped AS (SELECT *, concat('g_', min(row_uid) OVER (PARTITION BY a // gcd(a, b), b // gcd(a, b))) AS group_id FROM v)"""


def greedy_folds(name, source, salt, folds):
    """Literal largest-first greedy as recursive CTEs ``{name}_o`` and ``{name}``."""
    zeros = "[" + ",".join(["0"] * folds) + "]::BIGINT[]"
    return f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY n DESC, h) AS i FROM (SELECT group_id AS gid, count(*) AS n,
  sha256(concat('[42,"{salt}","', group_id, '"]')) AS h FROM {source} GROUP BY 1)),
{name}_s(i, gid, n, fold, tot, cnt) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::BIGINT, {zeros}, {zeros}
  UNION ALL SELECT z.i, z.gid, z.n, z.fo,
    list_transform(z.tot, lambda x, j: CASE WHEN j = z.fo + 1 THEN x + z.n ELSE x END),
    list_transform(z.cnt, lambda x, j: CASE WHEN j = z.fo + 1 THEN x + 1 ELSE x END)
  FROM (SELECT o.i, o.gid, o.n, s.tot, s.cnt, list_sort(list_transform(generate_series(1, {folds}),
      lambda j: s.tot[j] * 1000000000000 + s.cnt[j] * 1000 + j - 1))[1] % 1000 AS fo
    FROM {name}_s s JOIN {name}_o o ON o.i = s.i + 1) z),
{name} AS (SELECT gid AS group_id, fold, n FROM {name}_s WHERE i > 0)"""


CORE = "('Li','Mg','Ca','Zn','Al','Y')"
SPLIT = f"""{GROUPED},
core AS (SELECT * FROM grouped WHERE eligible AND working_ion IN {CORE}),
held AS (SELECT group_id, row_number() OVER (ORDER BY sha256(concat('[42,"holdout","', group_id, '"]'))) <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ()) AS held
  FROM (SELECT DISTINCT group_id FROM core)),
dev AS (SELECT core.* FROM core JOIN held USING (group_id) WHERE NOT held.held),
dev_li AS (SELECT * FROM dev WHERE working_ion = 'Li'),
{greedy_folds('mixed', 'dev', 'mixed_cv', 10)},
{greedy_folds('li', 'dev_li', 'li_cv', 10)},
split AS (SELECT g.*, CASE WHEN NOT eligible THEN 'quarantine' WHEN working_ion IN ('Na','K') THEN concat('held_out_', working_ion)
    WHEN held.held THEN 'holdout' ELSE 'development' END AS partition,
  CASE WHEN eligible AND working_ion IN {CORE} AND NOT held.held THEN mixed.fold END AS mixed_cv_fold,
  CASE WHEN eligible AND working_ion = 'Li' AND NOT held.held THEN li.fold END AS li_cv_fold,
  CASE WHEN eligible AND working_ion IN ('Na','K') THEN mixed.group_id IS NOT NULL END AS in_mixed,
  CASE WHEN eligible AND working_ion IN ('Na','K') THEN li.group_id IS NOT NULL END AS in_li
  FROM grouped g LEFT JOIN held USING (group_id) LEFT JOIN mixed USING (group_id) LEFT JOIN li USING (group_id))"""

ION_Z = "CASE ion WHEN 'Li' THEN 3 WHEN 'Na' THEN 11 WHEN 'K' THEN 19 WHEN 'Mg' THEN 12 WHEN 'Ca' THEN 20 WHEN 'Zn' THEN 30 WHEN 'Al' THEN 13 ELSE 39 END"
ION_POS = "CASE ion WHEN 'Li' THEN 0 WHEN 'Na' THEN 1 WHEN 'K' THEN 2 WHEN 'Mg' THEN 3 WHEN 'Ca' THEN 4 WHEN 'Zn' THEN 5 WHEN 'Al' THEN 6 ELSE 7 END"
ION_ROW = "CASE ion WHEN 'Li' THEN 2 WHEN 'Na' THEN 3 WHEN 'K' THEN 4 WHEN 'Mg' THEN 3 WHEN 'Ca' THEN 4 WHEN 'Zn' THEN 4 WHEN 'Al' THEN 3 ELSE 5 END"


def _system_pos(sg):
    return (f"CASE WHEN {sg} <= 2 THEN 0 WHEN {sg} <= 15 THEN 1 WHEN {sg} <= 74 THEN 2 WHEN {sg} <= 142 THEN 3 "
            f"WHEN {sg} <= 167 THEN 4 WHEN {sg} <= 194 THEN 5 ELSE 6 END")


# Non-zero feature entries of every clean reaction, computed from the integers.
LONG = f"""fr AS (SELECT k, c, ion, a, b, m, sg_c, sg_d, mv, gcd(a, b) AS g, {ION_Z} AS z, CAST(m AS DOUBLE) / (m + a + 5 * b) AS fm,
  CAST(a AS DOUBLE) / (a + 5 * b) AS ca, CAST(b AS DOUBLE) / (a + 5 * b) AS cp, CAST(4 * b AS DOUBLE) / (a + 5 * b) AS co,
  CAST(a AS DOUBLE) / (m + a + 5 * b) AS da, CAST(b AS DOUBLE) / (m + a + 5 * b) AS dp, CAST(4 * b AS DOUBLE) / (m + a + 5 * b) AS do_ FROM rx),
fs AS (SELECT *, 26 * ca + 15 * cp + 8 * co AS mc, 26 * da + 15 * dp + 8 * do_ + z * fm AS md FROM fr),
entries AS (SELECT k, c, ion, mv, unnest([
  {{'idx': 25, 'val': ca}}, {{'idx': 14, 'val': cp}}, {{'idx': 7, 'val': co}},
  {{'idx': 143, 'val': da}}, {{'idx': 132, 'val': dp}}, {{'idx': 125, 'val': do_}}, {{'idx': 117 + z, 'val': fm}},
  {{'idx': 236, 'val': mc}}, {{'idx': 237, 'val': sqrt(ca * (26 - mc) ** 2 + cp * (15 - mc) ** 2 + co * (8 - mc) ** 2)}},
  {{'idx': 238, 'val': 8.0}}, {{'idx': 239, 'val': 26.0}}, {{'idx': 240, 'val': 3.0}},
  {{'idx': 241, 'val': -(ca * ln(ca) + cp * ln(cp) + co * ln(co))}}, {{'idx': 242, 'val': sqrt(ca * ca + cp * cp + co * co)}},
  {{'idx': 243, 'val': md}}, {{'idx': 244, 'val': sqrt(da * (26 - md) ** 2 + dp * (15 - md) ** 2 + do_ * (8 - md) ** 2 + fm * (z - md) ** 2)}},
  {{'idx': 245, 'val': least(8, z)}}, {{'idx': 246, 'val': greatest(26, z)}}, {{'idx': 247, 'val': 4.0}},
  {{'idx': 248, 'val': -(da * ln(da) + dp * ln(dp) + do_ * ln(do_) + fm * ln(fm))}},
  {{'idx': 249, 'val': sqrt(da * da + dp * dp + do_ * do_ + fm * fm)}},
  {{'idx': 250 + {ION_POS}, 'val': 1.0}}, {{'idx': 258, 'val': z}}, {{'idx': 259, 'val': {ION_ROW}}},
  {{'idx': 261, 'val': fm}}, {{'idx': 262, 'val': fm}}, {{'idx': 264, 'val': CAST(m AS DOUBLE) / g}}, {{'idx': 265, 'val': CAST(m AS DOUBLE) / g}},
  {{'idx': 266 + {_system_pos('sg_c')}, 'val': 1.0}}, {{'idx': 273 + {_system_pos('sg_d')}, 'val': 1.0}},
  {{'idx': 279 + sg_c, 'val': 1.0}}, {{'idx': 509 + sg_d, 'val': 1.0}}]) AS e FROM fs),
long AS (SELECT k, c, ion, mv, CAST(e.idx AS INT) AS idx, CAST(e.val AS DOUBLE) AS val FROM entries)"""
