"""SQL for DuckDB that gives the same rows as each query, written independently of it."""

from __future__ import annotations

from lotline.sources.bands import DEFAULT_BANDS
from workloads.tables import AS_OF_YEAR

_SPACES = "chr(32) || chr(9) || chr(12288)"


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_BANDS = "bands(band_ord, id, label, min_year, max_year, color) AS (VALUES " + ", ".join(
    f"({i}, {_value(b.id)}, {_value(b.label)}, {_value(b.min_year)}, {_value(b.max_year)}, {_value(b.color)})"
    for i, b in enumerate(DEFAULT_BANDS)
) + ")"

_LINE_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice"

_BRIDGE = f"""
points AS (
  SELECT CAST(l_partkey AS VARCHAR) AS ml,
         CASE WHEN l_quantity > 1 THEN CAST(CASE l_partkey % 3 WHEN 0 THEN l_partkey * 5
           WHEN 1 THEN l_partkey * 5 + l_linenumber % 2 ELSE l_orderkey END AS VARCHAR) END AS bldg_id,
         row_number() OVER (ORDER BY {_LINE_ORDER}) AS ord
  FROM lineitem),
lookup AS (
  SELECT ml, count(*) AS n_points,
         arg_min(bldg_id, ord) FILTER (WHERE bldg_id IS NOT NULL) AS bldg_id,
         count(DISTINCT bldg_id) > 1 AS ambiguous
  FROM points GROUP BY ml),
properties AS (
  SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS gis_id, p_size AS street, p_size || ' ' || p_name AS address,
         CAST(1580 + p_partkey % 470 AS INTEGER) AS y, p_type, p_brand
  FROM part),
matches AS (
  SELECT p.*, l.bldg_id, l.ambiguous FROM properties p JOIN lookup l ON p.gis_id = l.ml WHERE l.bldg_id IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bldg_id ORDER BY street, address, ord) AS rk,
         count(*) OVER (PARTITION BY bldg_id) AS n_matches,
         bool_or(ambiguous) OVER (PARTITION BY bldg_id) AS any_ambiguous
  FROM matches),
reps AS (SELECT *, any_ambiguous OR n_matches > 1 AS amb FROM ranked WHERE rk = 1),
{_BANDS},
ages AS (
  SELECT o_orderkey AS building_ord, r.gis_id AS "GISID", r.address AS "Address",
         CASE WHEN r.y BETWEEN 1600 AND {AS_OF_YEAR} THEN r.y END AS "Condition_YearBuilt",
         r.p_type AS "PropertyClass", r.p_brand AS "Zoning",
         CASE WHEN r.y BETWEEN 1600 AND {AS_OF_YEAR} THEN {AS_OF_YEAR} - r.y END AS age,
         coalesce((SELECT arg_min(b.id, b.band_ord) FROM bands b
                   WHERE r.y BETWEEN 1600 AND {AS_OF_YEAR}
                     AND r.y >= coalesce(b.min_year, r.y) AND r.y <= coalesce(b.max_year, r.y)), 'unknown') AS age_band,
         CASE WHEN r.gis_id IS NULL THEN 'unmatched'
              WHEN r.y BETWEEN 1600 AND {AS_OF_YEAR} THEN 'matched' ELSE 'invalid_year' END AS join_status,
         coalesce(r.amb, false) AS join_ambiguous
  FROM orders o LEFT JOIN reps r ON CAST(o.o_orderkey AS VARCHAR) = r.bldg_id)
"""

_PART_YEARS = f"""
years AS (
  SELECT p_partkey, p_name,
         CASE WHEN 1580 + p_partkey % 470 BETWEEN 1600 AND {AS_OF_YEAR}
              THEN CAST(1580 + p_partkey % 470 AS INTEGER) END AS year
  FROM part),
{_BANDS},
banded AS (
  SELECT y.*, coalesce((SELECT arg_min(b.id, b.band_ord) FROM bands b
                        WHERE (b.min_year IS NULL OR y.year >= b.min_year)
                          AND (b.max_year IS NULL OR y.year <= b.max_year) AND y.year IS NOT NULL),
                       'unknown') AS age_band
  FROM years y)
"""

_VARIANTS = f"""
variants AS (
  SELECT p_partkey, p_size, p_type, p_name, p_partkey % 9 AS kind,
         CASE p_partkey % 9
           WHEN 0 THEN p_partkey || '.0'
           WHEN 1 THEN '  ' || p_name || chr(12288) || chr(9)
           WHEN 2 THEN p_partkey || '.0.0'
           WHEN 3 THEN p_partkey || ' .0'
           WHEN 4 THEN NULL
           WHEN 5 THEN ''
           WHEN 6 THEN '00' || p_size || '-' || p_partkey || ' ' || p_type
           WHEN 7 THEN 'c.' || (1580 + p_partkey % 470) || '.5'
           ELSE '-' || p_size || 'a,' || p_partkey END AS raw
  FROM part)
"""

_PLACES = """
places AS (
  SELECT o_orderkey AS point_id, o_orderstatus, -71.19::DOUBLE + o_totalprice * 0.000000312345679::DOUBLE AS lon,
         42.29::DOUBLE + ((o_custkey * 104729 + o_orderkey * 31) % 16001) * 0.00001::DOUBLE AS lat
  FROM orders)
"""

_TARGETS = """
targets AS (
  SELECT c_custkey AS target_id, c_mktsegment, -71.185::DOUBLE + (c_acctbal + 1000.0::DOUBLE) * 0.0000129::DOUBLE AS lon,
         42.295::DOUBLE + ((c_custkey * 7919) % 15013) * 0.00000973::DOUBLE AS lat,
         0.00035::DOUBLE + c_nationkey * 0.0001::DOUBLE AS reach
  FROM customer)
"""

_INSIDE = """
inside AS (
  SELECT p.point_id, t.target_id AS polygon_id
  FROM places p JOIN targets t ON abs(p.lon - t.lon) + abs(p.lat - t.lat) < t.reach)
"""


def _y(lat: str) -> str:
    s = f"sin({lat} * pi() / 180)"
    return f"(0.5 - 0.25 * ln((1 + {s}) / (1 - {s})) / pi())"


def _x(lon: str) -> str:
    return f"({lon} / 360 + 0.5)"


_KX = "pi() / 180 * 6378137.0 * sqrt(1 / (1 - e2 * (1 - c * c))) * c"
_KY = "pi() / 180 * 6378137.0 * sqrt(1 / (1 - e2 * (1 - c * c))) * (1 / (1 - e2 * (1 - c * c))) * (1 - e2)"

_SCALED = f"""
scaled AS (SELECT *, {_KX} AS kx, {_KY} AS ky FROM (
  SELECT *, cos(lat * (pi() / 180)) AS c, 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM places))
"""

# Of every point and edge (target_id, ax, ay, bx, by) the distance, by the foot of the perpendicular.
_TO_EDGES = """
feet AS (
  SELECT point_id, target_id, vx, vy, ux, uy, greatest(0, least(1, (vx * ux + vy * uy) / (ux * ux + uy * uy))) AS t
  FROM (SELECT point_id, target_id, (lon - ax) * kx AS vx, (lat - ay) * ky AS vy, (bx - ax) * kx AS ux, (by_ - ay) * ky AS uy
        FROM scaled, edges)),
apart AS (SELECT point_id, target_id, sqrt((vx - t * ux) * (vx - t * ux) + (vy - t * uy) * (vy - t * uy)) AS d FROM feet)
"""

ORACLE: dict[str, str] = {
    "building_age": f"WITH {_BRIDGE} SELECT * FROM ages",
    "linked_from_files": f"WITH {_BRIDGE} SELECT * FROM ages",
    "written_and_read": f"WITH {_BRIDGE} SELECT * FROM ages",
    "point_lookup": f"WITH {_BRIDGE} SELECT ml, n_points, bldg_id, ambiguous FROM lookup",
    "building_semi": f"""WITH {_BRIDGE} SELECT gis_id, bldg_id, ambiguous FROM matches
        WHERE bldg_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)""",
    "representative_property": f"""WITH {_BRIDGE} SELECT bldg_id, n_matches, amb AS ambiguous, address, gis_id,
        CAST(y AS BIGINT) AS year, p_type AS property_class, p_brand AS zoning FROM reps""",
    "drop_blank_keys": f"WITH {_BRIDGE} SELECT ml, bldg_id FROM points WHERE bldg_id IS NOT NULL",
    "lowest_address": """SELECT p_brand, p_type, arg_min(p_size || ' ' || p_name, (p_size, p_name)) AS lowest_address
        FROM part GROUP BY p_brand, p_type""",
    "quality_report": f"""WITH {_BRIDGE} SELECT count(*) AS total,
        count(*) FILTER (WHERE join_status = 'matched') AS matched,
        count(*) FILTER (WHERE join_status = 'unmatched') AS unmatched,
        count(*) FILTER (WHERE join_status = 'invalid_year') AS invalid_year,
        count(*) FILTER (WHERE join_ambiguous) AS ambiguous,
        round(count(*) FILTER (WHERE join_status = 'matched')::DOUBLE / count(*) * 100, 2) AS match_pct,
        round(count(*) FILTER (WHERE join_status = 'matched')::DOUBLE / count(*) * 100, 2) AS valid_year_coverage_pct
        FROM ages""",
    "band_counts": f"""WITH {_BRIDGE} SELECT b.band_ord, b.id AS age_band, count(a.building_ord) AS n_buildings
        FROM bands b LEFT JOIN ages a ON a.age_band = b.id AND a.join_status = 'matched' GROUP BY b.band_ord, b.id""",
    "year_coverage": """SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 5 IN (0, 2)) AS with_year,
        round(count(*) FILTER (WHERE p_partkey % 5 IN (0, 2))::DOUBLE / count(*) * 100, 1) AS coverage_pct FROM part""",
    "key_overlap": """SELECT
        (SELECT count(DISTINCT l_partkey) FROM lineitem) AS property_ids,
        (SELECT count(DISTINCT o_orderkey) FROM orders) AS building_ids,
        (SELECT count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders)) AS common_ids""",
    "key_overlap_sample": """SELECT CAST(l_partkey AS VARCHAR) AS id FROM (
          SELECT l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS ord FROM lineitem)
        WHERE l_partkey IN (SELECT o_orderkey FROM orders) GROUP BY l_partkey ORDER BY min(ord) LIMIT 20""",
    "normalize_id": f"""WITH {_VARIANTS} SELECT p_partkey, CASE kind
          WHEN 0 THEN CAST(p_partkey AS VARCHAR)
          WHEN 2 THEN p_partkey || '.0'
          WHEN 3 THEN p_partkey || ' '
          WHEN 7 THEN upper(raw)
          ELSE upper(trim(coalesce(raw, ''), {_SPACES})) END AS id
        FROM variants""",
    "street_number": f"""WITH {_VARIANTS} SELECT p_partkey, CASE
          WHEN kind IN (0, 2, 3) THEN p_partkey::DOUBLE WHEN kind = 6 THEN p_size::DOUBLE ELSE -1::DOUBLE END AS street_number
        FROM variants""",
    "parse_year": f"""WITH {_VARIANTS} SELECT p_partkey, CASE
          WHEN kind = 0 THEN p_partkey
          WHEN kind = 2 THEN CAST(p_partkey || '0' AS BIGINT)
          WHEN kind = 3 THEN p_partkey
          WHEN kind = 6 THEN p_size
          WHEN kind = 7 THEN CAST((1580 + p_partkey % 470) || '5' AS BIGINT)
          WHEN kind = 8 THEN CAST('-' || p_size || p_partkey AS BIGINT) END AS year
        FROM variants""",
    "truthy_coalesce": """WITH v AS (SELECT p_partkey,
          CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_name END AS a,
          CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_type END AS b,
          CASE WHEN p_size % 5 > 1 THEN p_size WHEN p_size % 5 = 1 THEN 0 END AS m,
          CASE WHEN p_partkey % 2 = 0 THEN 0 END AS n FROM part)
        SELECT p_partkey, CASE WHEN a <> '' THEN a ELSE b END AS text_value,
          CASE WHEN m <> 0 THEN m ELSE n END AS number_value FROM v""",
    "exact_case_keys": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS zoning,
        p_partkey % 2 = 0 AS has_upper, p_partkey % 2 = 1 AS has_zone FROM part""",
    "age_band": f"WITH {_PART_YEARS} SELECT p_partkey, year, age_band FROM banded",
    "age_band_range_join": f"""WITH {_BANDS}, years AS (SELECT p_partkey, CAST(1480 + p_partkey % 670 AS INTEGER) AS year FROM part)
        SELECT p_partkey, year, coalesce((SELECT arg_min(b.id, b.band_ord) FROM bands b
          WHERE (b.min_year IS NULL OR year >= b.min_year) AND (b.max_year IS NULL OR year <= b.max_year)), 'unknown') AS age_band
        FROM years""",
    "band_dim": f"""WITH {_PART_YEARS} SELECT b.band_ord, b.id, b.label, b.color, count(p_partkey) AS n_parts
        FROM bands b LEFT JOIN banded ON age_band = b.id GROUP BY ALL""",
    "band_color": f"""WITH {_PART_YEARS}, named AS (
          SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_name ELSE age_band END AS age_band FROM banded)
        SELECT p_partkey, age_band, coalesce(color, '#999999') AS color FROM named LEFT JOIN bands ON age_band = id""",
    "band_filter": f"""WITH {_PART_YEARS} SELECT p_partkey, age_band FROM banded
        WHERE age_band IN ('1820_1850', '1980-present')""",
    "display_card": """SELECT p_partkey AS ord,
        CASE p_partkey % 5 WHEN 4 THEN 'a&quot;b' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Unknown'
          ELSE p_name || ' &amp; &lt;&#39;' || p_brand || '&#39;&gt;' END AS address,
        CASE WHEN p_partkey % 5 IN (1, 4) THEN CAST(1580 + p_partkey % 470 AS VARCHAR) ELSE 'Unknown' END AS year_built,
        CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'true' ELSE 'Unknown' END AS age
        FROM part""",
    "scan_features": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'number' AS k_type,
        array_to_string(json_keys(props), ',') AS keys FROM events""",
    "round_coords": """SELECT vec_id, CAST(i AS INTEGER) AS pos, round(embedding[2 * i + 1]::DOUBLE, 6) AS lon,
        round(embedding[2 * i + 2]::DOUBLE, 6) AS lat FROM embeddings, range(32) AS t(i)""",
    "feature_json": f"""WITH {_BRIDGE}, {_PLACES} SELECT building_ord AS ord,
        '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || round(lon, 6) || ',' || round(lat, 6) || ']}}'
        || ',"properties":{{"GISID":' || coalesce(CAST(to_json("GISID") AS VARCHAR), 'null')
        || ',"Address":' || coalesce(CAST(to_json("Address") AS VARCHAR), 'null')
        || ',"Condition_YearBuilt":' || coalesce(CAST("Condition_YearBuilt" AS VARCHAR), 'null')
        || ',"PropertyClass":' || coalesce(CAST(to_json("PropertyClass") AS VARCHAR), 'null')
        || ',"Zoning":' || coalesce(CAST(to_json("Zoning") AS VARCHAR), 'null')
        || ',"age":' || coalesce(CAST(age AS VARCHAR), 'null')
        || ',"age_band":"' || age_band || '","join_status":"' || join_status
        || '","join_ambiguous":' || CASE WHEN join_ambiguous THEN 'true' ELSE 'false' END || '}}}}' AS feature
        FROM ages JOIN places ON building_ord = point_id""",
    "feature_diff": f"""WITH
        changes AS (SELECT *, row_number() OVER (ORDER BY {_LINE_ORDER}) AS ord,
          CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN -1 - l_orderkey ELSE l_orderkey END AS id FROM lineitem),
        removed AS (SELECT DISTINCT id FROM changes WHERE l_returnflag = 'R'),
        added AS (SELECT * FROM changes WHERE l_returnflag = 'A'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
        updates AS (SELECT * FROM changes WHERE l_returnflag = 'N'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
        present AS (
          SELECT id, 'part ' || l_partkey AS geometry, l_linestatus AS status, NULL AS priority,
                 CAST(l_linenumber AS VARCHAR) AS line FROM added
          UNION ALL
          SELECT o_orderkey, 'customer ' || o_custkey, o_orderstatus, o_orderpriority, NULL FROM orders
          WHERE o_orderkey NOT IN (SELECT id FROM removed) AND o_orderkey NOT IN (SELECT id FROM added))
        SELECT p.id, CASE WHEN u.l_tax > 0.04::DOUBLE THEN 'part ' || u.l_partkey ELSE p.geometry END AS geometry,
          CASE WHEN u.id IS NULL THEN p.status WHEN u.l_linenumber = 7 THEN NULL ELSE 'moved ' || u.l_suppkey END AS status,
          CASE WHEN u.l_linenumber > 4 THEN NULL ELSE p.priority END AS priority,
          CASE WHEN u.l_linenumber = 7 THEN NULL ELSE p.line END AS line
        FROM present p LEFT JOIN updates u ON p.id = u.id""",
    "feature_diff_typed": f"""WITH
        changes AS (SELECT *, row_number() OVER (ORDER BY {_LINE_ORDER}) AS ord,
          'o' || CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN -1 - l_orderkey ELSE l_orderkey END AS id FROM lineitem),
        removed AS (SELECT DISTINCT id FROM changes WHERE l_returnflag = 'R'),
        added AS (SELECT * FROM changes WHERE l_returnflag = 'A'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
        updates AS (SELECT * FROM changes WHERE l_returnflag = 'N'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
        present AS (
          SELECT id, l_quantity AS total, true AS paid, NULL AS priority FROM added
          UNION ALL
          SELECT 'o' || o_orderkey, o_totalprice, o_custkey % 2 = 0, o_orderpriority FROM orders
          WHERE 'o' || o_orderkey NOT IN (SELECT id FROM removed) AND 'o' || o_orderkey NOT IN (SELECT id FROM added))
        SELECT p.id, CASE WHEN u.id IS NULL THEN p.total WHEN u.l_linenumber = 7 THEN NULL ELSE u.l_suppkey END AS total,
          CASE WHEN u.id IS NULL THEN 'DOUBLE' WHEN u.l_linenumber = 7 THEN NULL ELSE 'BIGINT' END AS total_type,
          CASE WHEN u.l_linenumber = 7 THEN NULL ELSE p.paid END AS paid,
          CASE WHEN u.l_linenumber > 4 THEN NULL ELSE p.priority END AS priority
        FROM present p LEFT JOIN updates u ON p.id = u.id""",
    "tile_rollup": f"""WITH {_PLACES} SELECT 14 AS z, CAST(floor({_x('lon')} * 16384) AS INTEGER) AS x,
        CAST(floor({_y('lat')} * 16384) AS INTEGER) AS y, o_orderstatus, count(*) AS n_features FROM places GROUP BY ALL""",
    "tile_rollup_polygons": f"""WITH {_TARGETS}, boxes AS (SELECT c_mktsegment,
          CAST(floor({_x('(lon - reach)')} * 32768 - 0.25) AS INTEGER) AS x0,
          CAST(floor({_x('(lon + reach)')} * 32768 + 0.25) AS INTEGER) AS x1,
          CAST(floor({_y('(lat + reach)')} * 32768 - 0.25) AS INTEGER) AS y0,
          CAST(floor({_y('(lat - reach)')} * 32768 + 0.25) AS INTEGER) AS y1 FROM targets),
        cols AS (SELECT c_mktsegment, unnest(generate_series(x0, x1)) AS x, y0, y1 FROM boxes),
        cells AS (SELECT c_mktsegment, x, unnest(generate_series(y0, y1)) AS y FROM cols)
        SELECT 15 AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, c_mktsegment, count(*) AS n_features
        FROM cells GROUP BY ALL""",
    "points_within": f"WITH {_PLACES}, {_TARGETS}, {_INSIDE} SELECT point_id, polygon_id FROM inside",
    "within_any": f"""WITH {_PLACES}, {_TARGETS}, {_INSIDE} SELECT point_id,
        point_id IN (SELECT point_id FROM inside) AS within FROM places""",
    "lines_within": f"""WITH {_PLACES}, {_TARGETS},
        sized AS (SELECT *, (point_id % 7 + 1) * 0.0001::DOUBLE AS s FROM places),
        lines AS (SELECT point_id AS line_id, lon, lat,
          [{{'x': lon, 'y': lat}}, {{'x': lon + s, 'y': lat - s / 8}}, {{'x': lon + s / 2, 'y': lat - s}}] AS v FROM sized),
        darts AS (SELECT target_id AS polygon_id, lon, lat, reach, [
          {{'ax': lon - reach, 'ay': lat - reach, 'bx': lon, 'b_y': lat - reach / 4}},
          {{'ax': lon, 'ay': lat - reach / 4, 'bx': lon + reach, 'b_y': lat - reach}},
          {{'ax': lon + reach, 'ay': lat - reach, 'bx': lon, 'b_y': lat + reach}},
          {{'ax': lon, 'ay': lat + reach, 'bx': lon - reach, 'b_y': lat - reach}}] AS e FROM targets),
        near AS (SELECT line_id, polygon_id, v, e FROM lines l JOIN darts d
          ON l.lon > d.lon - reach AND l.lon < d.lon + reach AND l.lat > d.lat - reach AND l.lat < d.lat + reach),
        held AS (SELECT * FROM near WHERE len(list_filter(v, lambda p: len(list_filter(e, lambda g:
            (p.y >= g.ay AND p.y < g.b_y AND (g.bx - g.ax) * (p.y - g.ay) - (g.b_y - g.ay) * (p.x - g.ax) > 0)
            OR (p.y >= g.b_y AND p.y < g.ay AND (g.bx - g.ax) * (p.y - g.ay) - (g.b_y - g.ay) * (p.x - g.ax) < 0))) % 2 = 1)) = 3),
        sides AS (SELECT line_id, polygon_id, unnest(e) AS g, v FROM held),
        steps AS (SELECT line_id, polygon_id, g, unnest([{{'p': v[1], 'q': v[2]}}, {{'p': v[2], 'q': v[3]}}]) AS w FROM sides),
        crossed AS (SELECT DISTINCT line_id, polygon_id FROM steps WHERE
          sign((g.bx - g.ax) * (w.p.y - g.ay) - (g.b_y - g.ay) * (w.p.x - g.ax)) * sign((g.bx - g.ax) * (w.q.y - g.ay) - (g.b_y - g.ay) * (w.q.x - g.ax)) < 0
          AND sign((w.q.x - w.p.x) * (g.ay - w.p.y) - (w.q.y - w.p.y) * (g.ax - w.p.x)) * sign((w.q.x - w.p.x) * (g.b_y - w.p.y) - (w.q.y - w.p.y) * (g.bx - w.p.x)) < 0)
        SELECT line_id, polygon_id FROM held ANTI JOIN crossed USING (line_id, polygon_id)""",
    "hit_test": f"""WITH {_PLACES}, {_TARGETS}, {_INSIDE}
        SELECT point_id, min(polygon_id) AS polygon_id FROM inside GROUP BY point_id""",
    "nearest_point": f"""WITH {_PLACES}, {_TARGETS},
        scaled AS (SELECT *, {_KX} AS kx, {_KY} AS ky FROM (
          SELECT *, cos(lat * (pi() / 180)) AS c, 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM places)),
        pairs AS (SELECT point_id, target_id,
          sqrt((p.lon - t.lon) * kx * ((p.lon - t.lon) * kx) + (p.lat - t.lat) * ky * ((p.lat - t.lat) * ky)) AS d
          FROM scaled p, targets t)
        SELECT point_id, arg_min(target_id, (d, target_id)) AS target_id, round(min(d), 3) AS metres
        FROM pairs GROUP BY point_id""",
    "nearest_polygon": f"""WITH {_PLACES}, {_TARGETS}, {_INSIDE}, {_SCALED},
        edges AS (
          SELECT target_id, lon - reach AS ax, lat AS ay, lon AS bx, lat - reach AS by_ FROM targets UNION ALL
          SELECT target_id, lon, lat - reach, lon + reach, lat FROM targets UNION ALL
          SELECT target_id, lon + reach, lat, lon, lat + reach FROM targets UNION ALL
          SELECT target_id, lon, lat + reach, lon - reach, lat FROM targets),
        {_TO_EDGES},
        every AS (SELECT * FROM apart UNION ALL SELECT point_id, polygon_id, 0.0 FROM inside)
        SELECT point_id, arg_min(target_id, (d, target_id)) AS target_id, round(min(d), 3) AS metres
        FROM every GROUP BY point_id""",
    "nearest_line": f"""WITH {_PLACES}, {_TARGETS}, {_SCALED},
        bends AS (SELECT *, (target_id % 13) * 0.0001::DOUBLE AS bend FROM targets),
        edges AS (
          SELECT target_id, lon AS ax, lat AS ay, lon + reach AS bx, lat + reach / 4 AS by_ FROM bends UNION ALL
          SELECT target_id, lon + reach, lat + reach / 4, lon + reach + bend, lat - bend FROM bends),
        {_TO_EDGES}
        SELECT point_id, arg_min(target_id, (d, target_id)) AS target_id, round(min(d), 3) AS metres
        FROM apart GROUP BY point_id""",
    "cluster_rollup": f"""WITH {_PLACES}, cells AS (
          SELECT min(point_id) AS first_id, count(*) AS n, avg({_x('lon')}) AS x, avg({_y('lat')}) AS y FROM places
          GROUP BY floor({_x('lon')} * (512 * 65536 / 40.0::DOUBLE)), floor({_y('lat')} * (512 * 65536 / 40.0::DOUBLE)))
        SELECT n > 1 AS is_cluster, first_id, round((x - 0.5) * 360, 6) AS lon,
          round(360 * atan(exp((180 - y * 360) * pi() / 180)) / pi() - 90, 6) AS lat, n AS point_count
        FROM cells""",
    "cluster_rollup_weighted": f"""WITH {_PLACES}, doubled AS (
          SELECT *, CASE point_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 ELSE 0.0 END::DOUBLE AS w,
            {_x('lon')} AS mx, {_y('lat')} AS my FROM (SELECT * FROM places UNION ALL SELECT * FROM places WHERE point_id % 10 = 0)),
        cells AS (SELECT *, count(*) OVER c AS n, sum(w) OVER c AS s FROM doubled
          WINDOW c AS (PARTITION BY floor(mx * (512 * 65536 / 40.0::DOUBLE)), floor(my * (512 * 65536 / 40.0::DOUBLE)))),
        rows AS (
          SELECT true AS is_cluster, min(point_id) AS first_id, sum(mx * w) / sum(w) AS x, sum(my * w) / sum(w) AS y, sum(w) AS point_count
          FROM cells WHERE n > 1 AND s >= 3
          GROUP BY floor(mx * (512 * 65536 / 40.0::DOUBLE)), floor(my * (512 * 65536 / 40.0::DOUBLE))
          UNION ALL SELECT false, point_id, mx, my, w FROM cells WHERE NOT (n > 1 AND s >= 3))
        SELECT is_cluster, first_id, round((x - 0.5) * 360, 6) AS lon,
          round(360 * atan(exp((180 - y * 360) * pi() / 180)) / pi() - 90, 6) AS lat, point_count FROM rows""",
}
