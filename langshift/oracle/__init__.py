"""The same queries in plain SQL, written densely: every user times every topic, absent cells as zeros.

The engine works on sparse rows and algebra, so agreement of the two is a real check.  Each query is a
final SELECT over named tables; `compose` puts the tables it needs, directly or not, into WITH.
"""

from __future__ import annotations

import re

from langshift.config import Variant
from langshift.fixtures import COPIED_IDS, COPY_COUNTER, EARLY_TOPIC, LATE_TOPIC, LONELY, UNCOUNTED, VARIANTS
from langshift.operators.order_free import EXPONENTS, LOG_DIGITS, PIECE_BITS, PIECES
from langshift.operators.prep import RING_COUNTERS, SEED_COUNTER
from langshift.queries import FIRST_USER, THRESHOLD

INPUTS = {
    "messages": """
        SELECT o_orderkey AS message_id, o_custkey AS user_id, o_orderdate AS created_at,
               o_orderpriority = '5-LOW' AS is_rt
        FROM orders""",
    "messages_nrt": "SELECT * FROM messages WHERE NOT is_rt",
    "network": """
        SELECT o_custkey AS source_id, l_partkey AS dest_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_custkey <> l_partkey""",
    "accounts": f"""
        SELECT c_custkey AS id, c_name AS username, c_custkey % 4 AS level, c_custkey + copy.shift AS counter,
               coalesce(s.n, 0) AS statuses_count,
               CASE WHEN c_custkey % {UNCOUNTED} <> 0 THEN coalesce(f.n, 0) END AS recorded_friends_count,
               coalesce(f.n, 0) AS friends_count
        FROM customer
        JOIN (VALUES (0), ({COPY_COUNTER})) copy(shift) ON copy.shift = 0 OR c_custkey <= {COPIED_IDS}
        LEFT JOIN (SELECT user_id, count(*) AS n FROM messages GROUP BY user_id) s ON s.user_id = c_custkey
        LEFT JOIN (SELECT source_id, count(*) AS n FROM network GROUP BY source_id) f ON f.source_id = c_custkey""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY message_id) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n
        FROM messages_nrt""",
    "parts": """
        SELECT message_id, user_id,
               CASE WHEN 2 * (rn - 1) <= n - 1 THEN 1 ELSE 2 END AS half,
               CASE WHEN 3 * (rn - 1) <= n - 1 THEN 1 WHEN 3 * (rn - 1) <= 2 * (n - 1) THEN 2 ELSE 3 END AS third
        FROM ranked""",
    "trust_scores": f"""
        SELECT c_custkey AS user_id, CASE WHEN c_custkey % {LONELY} = 0 THEN 1 ELSE coalesce(f.n, 0) END AS num_of_friends, m.wo_retweets, m.first_part,
               m.second_part - m.first_part AS diff_score
        FROM customer
        LEFT JOIN (SELECT source_id, count(*) AS n FROM network GROUP BY source_id) f ON f.source_id = c_custkey
        LEFT JOIN (SELECT user_id, sum(cents)::DOUBLE / count(*) / 100 AS wo_retweets,
                          sum(cents) FILTER (half = 1)::DOUBLE / nullif(count(*) FILTER (half = 1), 0) / 100 AS first_part,
                          sum(cents) FILTER (half = 2)::DOUBLE / nullif(count(*) FILTER (half = 2), 0) / 100 AS second_part
                   FROM parts JOIN (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
                        ON o_orderkey = message_id GROUP BY user_id) m ON m.user_id = c_custkey""",
}


def _order_free(value: str, bits: int = 0) -> str:
    """Sum of doubles by whole numbers of 30 binary places each."""
    rest, totals = f"(({value}) * pow(2, {PIECE_BITS - bits}))", []
    for number in range(1, PIECES + 1):
        totals.append(f"sum(floor({rest})::BIGINT)::DOUBLE * pow(2, {bits - PIECE_BITS * number})")
        rest = f"(({rest} - floor({rest})) * pow(2, {PIECE_BITS}))"
    return " + ".join(totals)


def _features(tercile: int) -> dict[str, str]:
    in_reference = f"third = {tercile}" if tercile in (1, 2) else "true"
    return {
        "features": f"""
        SELECT slice, group_id, feat, value, value / sum(value) OVER (PARTITION BY slice, group_id) AS group_norm
        FROM (SELECT slice, user_id AS group_id, p_brand AS feat, count(*)::DOUBLE AS value
              FROM (SELECT message_id, user_id, half - 1 AS slice FROM parts
                    UNION ALL SELECT message_id, user_id, 2 FROM parts WHERE {in_reference}) p
              JOIN lineitem ON l_orderkey = message_id JOIN part ON p_partkey = l_partkey
              GROUP BY slice, user_id, p_brand)
        QUALIFY NOT (feat = '{LATE_TOPIC}' AND slice = 0) AND NOT (feat = '{EARLY_TOPIC}' AND slice > 0)""",
    }


_PRIME, _ROUNDS = 2147483647, 4
_KEY_NAMES = ", ".join(f"k{number}" for number in range(2 * _ROUNDS))


def _round_keys(seed: int) -> str:
    """Two keys per round from the hexadecimal digits of digests of the drawing user."""
    digests = [f"md5(concat_ws(':', id, {seed}, {part}))" for part in range(_ROUNDS // 2)]
    keys = [f"('0x' || substr({digest}, {1 + 8 * at}, 8))::BIGINT % {_PRIME}" for digest in digests for at in range(4)]
    return ", ".join(f"{key} AS k{number}" for number, key in enumerate(keys))


def _feistel(rows: str) -> str:
    """All half rounds, one subquery each, over rows with the halves l and r."""
    for number in range(2 * _ROUNDS):
        half, other, modulus = ("l", "r", "wide") if number % 2 == 0 else ("r", "l", "high")
        y = f"(({other} + k{number}) % {_PRIME})"
        rows = f"SELECT * REPLACE (({half} + {y} * {y} % {_PRIME} * {y} % {_PRIME}) % {modulus} AS {half}) FROM ({rows})"
    return rows


def _study(name: str, variant: Variant, tercile: int = 0) -> dict[str, str]:
    """All tables of one study."""
    v = variant
    if name == "trust":
        users = "SELECT user_id AS id, num_of_friends > 1 AS is_core FROM trust_scores"
        loaded = "SELECT id FROM users"
    else:
        active = f"statuses_count >= {v.min_statuses or 0}"
        popular = f"recorded_friends_count >= {v.min_friends}" if v.min_friends is not None else "true"
        counted = f"recorded_friends_count >= {v.min_recorded}" if v.min_recorded is not None else "true"
        users = f"""
        SELECT id, bool_or(level <= {v.core_level} AND {popular}) AS is_core FROM accounts
        WHERE level <= {v.all_level} AND {active} AND {counted} GROUP BY id"""
        loaded = "SELECT id FROM users WHERE is_core UNION SELECT dest_id FROM edges"
    if v.friend_cap is None:
        followed = "SELECT * FROM network WHERE dest_id IN (SELECT id FROM users)"
    else:
        followed = f"""
        SELECT source_id, dest_id
        FROM (SELECT source_id, dest_id, copy, sum(spacing) OVER (PARTITION BY source_id, dest_id ORDER BY copy) AS place
              FROM (SELECT source_id, dest_id, copy,
                           -ln((('0x' || substr(md5(concat_ws(':', source_id, dest_id, copy, {v.seed})), 1, 15))::BIGINT + 1)
                               / 1152921504606846976.0::DOUBLE) / (weight - copy + 1) AS spacing
                    FROM (SELECT source_id, dest_id, weight, unnest(range(1, least(weight, {v.friend_cap}) + 1)) AS copy
                          FROM (SELECT source_id, dest_id, count(*) AS weight FROM network
                                WHERE dest_id IN (SELECT id FROM users) GROUP BY source_id, dest_id))))
        QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY place, dest_id, copy) <= {v.friend_cap}"""
    divisor = {None: "1.0", "minmax": "max2 - min2", "variance": "var2"}[v.normalise]
    shift = {None: "0.0", "minmax": "min2", "variance": "mean2"}[v.normalise]
    base = "mean2" if v.baseline == "population" else "coalesce(bs.total / d.drawn, 0)"
    friend = "coalesce(fs.total / d.degree, 0)"
    if name == "trust":
        known = "d.id IN (SELECT user_id FROM averaged)"
        friend, base = (f"CASE WHEN {known} THEN {value} ELSE mean2 END" for value in (friend, base))
    return {
        **INPUTS,
        **_features(tercile),
        "users": users,
        "people": "SELECT count(*) AS n FROM users",
        "followed": followed,
        "edges": "SELECT * FROM followed WHERE source_id IN (SELECT id FROM users WHERE is_core)",
        "degrees": """
        SELECT id, count(dest_id) AS degree FROM users LEFT JOIN edges ON source_id = id
        WHERE is_core GROUP BY id""",
        "kept": f"SELECT * FROM degrees WHERE degree >= {v.min_degree}",
        "loaded": loaded,
        "averaged": """
        SELECT t.user_id, avg(f.wo_retweets) AS avg_friends
        FROM trust_scores t JOIN edges e ON e.source_id = t.user_id JOIN trust_scores f ON f.user_id = e.dest_id
        WHERE t.num_of_friends > 1 AND isfinite(t.diff_score)
        GROUP BY t.user_id HAVING avg(f.wo_retweets) IS NOT NULL""",
        "drawers": "SELECT * FROM degrees" + (" WHERE id IN (SELECT user_id FROM averaged)" if name == "trust" else ""),
        "positions": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM users",
        "draw_keys": f"""
        SELECT id AS source_id, least(degree, n) AS drawn, n, ceil(sqrt(n::DOUBLE))::BIGINT AS wide,
               (n + ceil(sqrt(n::DOUBLE))::BIGINT - 1) // ceil(sqrt(n::DOUBLE))::BIGINT AS high,
               {_round_keys(v.seed)}
        FROM drawers, people""",
        "draw_walk": f"""
        SELECT *, j AS place, 0 AS step FROM (SELECT *, unnest(range(drawn)) AS j FROM draw_keys)
        UNION ALL
        SELECT source_id, drawn, n, wide, high, {_KEY_NAMES}, j, l * high + r AS place, step + 1 AS step
        FROM ({_feistel("SELECT *, place // high AS l, place % high AS r FROM draw_walk WHERE step = 0 OR place >= n")})""",
        "draws": """
        SELECT source_id, id AS dest_id, drawn FROM draw_walk JOIN positions ON position = place WHERE step > 0 AND place < n""",
        "restricted": """
        SELECT * FROM features
        WHERE (slice < 2 AND group_id IN (SELECT id FROM users WHERE is_core))
           OR (slice = 2 AND group_id IN (SELECT id FROM loaded))""",
        "vocabulary": "SELECT DISTINCT feat FROM features"
        + (" WHERE slice = 0" if v.vocab_scope == "first" else ""),
        "cells": """
        SELECT s.slice, u.id, w.feat, coalesce(r.group_norm, 0) AS v, r.group_norm
        FROM (VALUES (0), (1), (2)) s(slice) CROSS JOIN users u CROSS JOIN vocabulary w
        LEFT JOIN restricted r ON r.slice = s.slice AND r.group_id = u.id AND r.feat = w.feat""",
        "statistics": """
        SELECT slice, feat, count(group_norm) AS "rows", avg(v) AS mean, var_pop(v) AS var, min(v) AS min, max(v) AS max
        FROM cells GROUP BY slice, feat""",
        "topics": """
        SELECT feat, max(mean) FILTER (slice = 2) AS mean2, max(var) FILTER (slice = 2) AS var2,
               max(min) FILTER (slice = 2) AS min2, max(max) FILTER (slice = 2) AS max2
        FROM statistics GROUP BY feat HAVING bool_and(max > min)""",
        "normalised": f"""
        SELECT slice, group_id, feat, (group_norm - ({shift})) / ({divisor}) AS score, -({shift}) / ({divisor}) AS zero_score
        FROM restricted JOIN topics USING (feat)""",
        "friend_sums": """
        SELECT e.source_id AS id, r.feat, sum(r.group_norm) AS total
        FROM edges e JOIN restricted r ON r.slice = 2 AND r.group_id = e.dest_id GROUP BY ALL""",
        "base_sums": """
        SELECT d.source_id AS id, r.feat, sum(r.group_norm) AS total
        FROM draws d JOIN restricted r ON r.slice = 2 AND r.group_id = d.dest_id GROUP BY ALL""",
        "dense": f"""
        SELECT d.id, t.feat, ({divisor}) AS divisor, c0.v AS s0, c1.v AS s1, {friend} AS friend_avg, {base} AS base_avg,
               coalesce(fs.total, 0) AS friend_total
        FROM (SELECT *, least(degree, (SELECT n FROM people)) AS drawn FROM kept) d CROSS JOIN topics t
        JOIN cells c0 ON c0.slice = 0 AND c0.id = d.id AND c0.feat = t.feat
        JOIN cells c1 ON c1.slice = 1 AND c1.id = d.id AND c1.feat = t.feat
        LEFT JOIN friend_sums fs ON fs.id = d.id AND fs.feat = t.feat
        """
        + ("LEFT JOIN base_sums bs ON bs.id = d.id AND bs.feat = t.feat" if v.baseline == "random" else ""),
        "deltas": """
        SELECT id, feat, s0, s1, friend_total, (s1 - s0) / divisor AS tt, (friend_avg - s0) / divisor AS tf,
               (base_avg - s0) / divisor AS tr
        FROM dense""",
        "cosines": """
        SELECT feat, coalesce(sum(tt * tf) / nullif(sqrt(sum(tt * tt)) * sqrt(sum(tf * tf)), 0), 0) AS cos_friends,
               coalesce(sum(tt * tr) / nullif(sqrt(sum(tt * tt)) * sqrt(sum(tr * tr)), 0), 0) AS cos_base
        FROM deltas GROUP BY feat""",
        "scales": f"""
        SELECT feat, CASE WHEN bound > 0 THEN pow(2, -greatest(ceil(round(log2(nullif(bound, 0)), {LOG_DIGITS})), -{EXPONENTS})) ELSE 1 END AS scale
        FROM (SELECT feat, max(greatest(abs(min), abs(max))) AS bound FROM statistics GROUP BY feat)""",
        "scaled": "SELECT slice, group_id, feat, group_norm * scale AS score, scale FROM restricted JOIN scales USING (feat)",
        "scaled_sums": f"""
        SELECT slice, feat, scale, count(*) AS k, {_order_free("score")} AS total FROM scaled GROUP BY slice, feat, scale""",
        "scaled_spreads": f"""
        SELECT slice, feat, {_order_free("(score - total / k) * (score - total / k)", 2)} AS squares
        FROM scaled JOIN scaled_sums USING (slice, feat, scale) GROUP BY slice, feat""",
        "exact_statistics": """
        SELECT s.slice, s.feat, s."rows", s.min, s.max, n, coalesce(t.total / t.scale, 0) AS total,
               coalesce(q.squares / t.k / t.scale / t.scale, 0) AS spread
        FROM statistics s LEFT JOIN scaled_sums t USING (slice, feat) LEFT JOIN scaled_spreads q USING (slice, feat), people""",
        "exact_base": """
        SELECT feat, total / n AS a FROM scaled_sums JOIN topics USING (feat), people WHERE slice = 2""",
        "exact_parts": """
        SELECT group_id AS id, feat, coalesce(max(score) FILTER (slice = 1), 0) - coalesce(max(score) FILTER (slice = 0), 0) AS tt,
               -coalesce(max(score) FILTER (slice = 0), 0) AS x, -coalesce(max(score) FILTER (slice = 0), 0) AS y
        FROM scaled WHERE slice < 2 AND group_id IN (SELECT id FROM kept) GROUP BY group_id, feat
        UNION ALL
        SELECT k.id, feat, 0, score * (weight / degree), 0
        FROM (SELECT source_id, dest_id, count(*) AS weight FROM edges GROUP BY ALL)
        JOIN kept k ON k.id = source_id JOIN scaled ON slice = 2 AND group_id = dest_id""",
        "exact_support": f"""
        SELECT id, feat, a, {_order_free("tt", 1)} AS tt, {_order_free("x", 1)} AS tf, {_order_free("y", 1)} + a AS tr
        FROM exact_parts JOIN exact_base USING (feat) GROUP BY id, feat, a""",
        "exact_moments": f"""
        SELECT feat, {_order_free("tt * tt", 4)} AS tt, {_order_free("tf * tf", 4)} AS ff, {_order_free("tt * tf", 4)} AS tf,
               {_order_free("tr * tr", 4)} + a * a * ((SELECT count(*) FROM kept) - count(*)) AS rr, {_order_free("tt * tr", 4)} AS tr
        FROM exact_support GROUP BY feat, a""",
        "exact_cosines": """
        SELECT feat, coalesce(tf / nullif(sqrt(tt) * sqrt(ff), 0), 0) AS cos_friends, coalesce(tr / nullif(sqrt(tt) * sqrt(rr), 0), 0) AS cos_base
        FROM exact_moments""",
        "means": "SELECT feat, avg(tt) AS t, avg(tf) AS f, avg(tr) AS r, count(*) AS n FROM deltas GROUP BY feat",
        "spreads": """
        SELECT feat, t, f, r, n, sum((tf - f) * (tf - f)) AS ff, sum((tr - r) * (tr - r)) AS rr,
               sum((tf - f) * (tr - r)) AS fr, sum((tf - f) * (tt - t)) AS tf, sum((tr - r) * (tt - t)) AS tr
        FROM deltas JOIN means USING (feat) GROUP BY feat, t, f, r, n""",
        "slopes": """
        SELECT feat, t, f, r, n,
               CASE WHEN ff * rr - fr * fr > 1e-10 * ff * rr THEN (tf * rr - tr * fr) / (ff * rr - fr * fr)
                    WHEN ff + rr > 0 THEN (ff * tf + fr * tr) / ((ff + rr) * (ff + rr)) ELSE 0 END AS b_friends,
               CASE WHEN ff * rr - fr * fr > 1e-10 * ff * rr THEN (tr * ff - tf * fr) / (ff * rr - fr * fr)
                    WHEN ff + rr > 0 THEN (fr * tf + rr * tr) / ((ff + rr) * (ff + rr)) ELSE 0 END AS b_base
        FROM spreads""",
        "fits": """
        SELECT feat, b_friends, b_base, t - b_friends * f - b_base * r AS intercept, n,
               avg(abs(tt - b_friends * tf - b_base * tr - (t - b_friends * f - b_base * r))) AS mae
        FROM deltas JOIN slopes USING (feat) GROUP BY feat, b_friends, b_base, t, f, r, n""",
    }


PREPARATION = {
    **INPUTS,
    "members": f"""
        SELECT DISTINCT dest_id FROM network JOIN accounts s ON source_id = s.id
        WHERE s.counter <= {SEED_COUNTER} AND dest_id IN (SELECT id FROM accounts)""",
    "core_messages": "SELECT * FROM messages_nrt WHERE user_id IN (SELECT dest_id FROM members)",
    "core_accounts": """
        SELECT * FROM accounts WHERE id IN (SELECT dest_id FROM members)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY counter) = 1""",
    "enriched": """
        SELECT id, (SELECT max(message_id) FROM messages m WHERE m.user_id = a.id) AS last_message_id,
               (SELECT max(created_at) FROM messages m WHERE m.user_id = a.id) AS last_message_date,
               (SELECT max(message_id) FROM core_messages m WHERE m.user_id = a.id) AS last_nrt_message_id,
               (SELECT max(created_at) FROM core_messages m WHERE m.user_id = a.id) AS last_nrt_message_date
        FROM core_accounts a""",
    "positions": """
        SELECT message_id, user_id, created_at, row_number() OVER (ORDER BY user_id, message_id) AS position
        FROM messages_nrt""",
    "bounds": "SELECT user_id, min(position) AS min_, max(position) AS max_ FROM positions GROUP BY user_id",
    "tercile": """
        SELECT p.* FROM positions p JOIN bounds b ON p.user_id = b.user_id AND p.position <= (b.min_ * 2.0 + b.max_ * 1.0) / 3.0""",
    "core_edges": "SELECT n.* FROM network n JOIN core_accounts a ON n.source_id = a.id",
    "fan_out": """
        SELECT m.*, n.source_id AS parent_id, concat(n.source_id, '_', m.user_id) AS parent_user_id,
               concat(n.source_id, '_', m.message_id) AS parent_message_id
        FROM core_edges n JOIN messages_nrt m ON n.dest_id = m.user_id""",
}


def compose(tables: dict[str, str], query: str) -> str:
    """The query with the tables it needs in front, in the order in which they build on each other."""
    needed: set[str] = set()
    pending = [query]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        found = {name for name in tables if name in words} - needed
        needed |= found
        pending += [tables[name] for name in found]
    ordered = [f"{name} AS ({body})" for name, body in tables.items() if name in needed]
    return f"WITH RECURSIVE {', '.join(ordered)} {query}" if ordered else query


def _r(*names: str) -> str:
    return ", ".join(f"round({name}, 6) + 0.0 AS {name}" for name in names)


_MAIN, _OLS, _RANDOM, _TRUST = "minmax_population", "ols_population", "capped_random", "trust"
_COSINE_QUERY = f"SELECT feat, {_r('cos_friends', 'cos_base')}, round(cos_friends - cos_base, 6) + 0.0 AS cos_diff FROM cosines"
_FIT = ("b_friends", "b_base", "intercept", "mae")
_COUNTS = {
    "all_users": "users",
    "core_users": "users WHERE is_core",
    "loaded_users": "loaded",
    "kept_users": "kept",
    "masked_users": "degrees WHERE degree < {min_degree}",
    "vocabulary": "vocabulary",
    "kept_topics": "topics",
}

# query name -> (variant, tercile, final SELECT)
STUDY_QUERIES: dict[str, tuple[str, int, str]] = {
    "users_all": (_MAIN, 0, "SELECT id FROM users"),
    "users_core": (_MAIN, 0, "SELECT id FROM users WHERE is_core"),
    "users_kept": (_MAIN, 0, "SELECT id, degree FROM kept"),
    "users_loaded": (_MAIN, 0, "SELECT id FROM loaded"),
    "users_loaded_set": (_MAIN, 0, "SELECT id FROM loaded"),
    "user_set_sizes": (
        _MAIN, 0,
        """SELECT (SELECT count(*) FROM users) AS all_users, (SELECT count(*) FROM users WHERE is_core) AS core_users,
                  (SELECT count(*) FROM loaded) AS loaded_users, (SELECT count(*) FROM users WHERE NOT is_core) AS periphery,
                  (SELECT count(*) FROM users WHERE is_core AND id IN (SELECT dest_id FROM edges)) AS core_followed""",
    ),
    "followers_bucketed": (
        _MAIN, 0,
        """SELECT dest_id, count(*) AS followers FROM network WHERE dest_id IN (SELECT id FROM users) GROUP BY dest_id""",
    ),
    "users_periphery": (_MAIN, 0, "SELECT id FROM users WHERE NOT is_core"),
    "user_degree": (_MAIN, 0, "SELECT id, degree FROM degrees"),
    "user_index": (_MAIN, 0, "SELECT id, is_core, row_number() OVER (ORDER BY is_core DESC, id) - 1 AS user_index FROM users"),
    "edges_core": (_MAIN, 0, "SELECT source_id, dest_id FROM edges"),
    "edges_capped": (_RANDOM, 0, "SELECT source_id, dest_id, count(*) AS weight FROM edges GROUP BY ALL"),
    "random_people": (_RANDOM, 0, "SELECT source_id, dest_id, drawn FROM draws"),
    "features_loaded": (_MAIN, 0, f"SELECT slice::BIGINT AS slice, group_id, feat, {_r('group_norm')} FROM restricted"),
    "features_var_norm": (
        _RANDOM, 0, f"SELECT slice::BIGINT AS slice, group_id, feat, {_r('score', 'zero_score')} FROM normalised",
    ),
    "features_minmax_norm": (
        _MAIN, 0, f"SELECT slice::BIGINT AS slice, group_id, feat, {_r('score', 'zero_score')} FROM normalised",
    ),
    "vocab": (_OLS, 0, "SELECT feat FROM vocabulary"),
    "topic_dictionary": (
        _OLS, 0,
        """SELECT feat, first_slice::BIGINT AS first_slice, row_number() OVER (ORDER BY first_slice, feat) AS topic_id
           FROM (SELECT feat, min(slice) AS first_slice FROM features GROUP BY feat)""",
    ),
    "unknown_topics": (
        _MAIN, 1,
        """SELECT count(DISTINCT feat) AS unknown_topics, count(*) AS unknown_rows FROM features
           WHERE feat NOT IN (SELECT feat FROM vocabulary)""",
    ),
    "slice_topic_stats": (
        _MAIN, 0, f"""SELECT slice::BIGINT AS slice, feat, "rows", {_r('mean', 'var', 'min', 'max')} FROM statistics""",
    ),
    "slice_topic_stats_order_free": (
        _MAIN, 0,
        """SELECT slice::BIGINT AS slice, feat, "rows", total / n AS mean,
                  "rows" / n * spread + total / n * (total / greatest("rows", 1)) * (n - "rows") / n AS var, min, max
           FROM exact_statistics""",
    ),
    "topics_kept": (_MAIN, 0, "SELECT feat FROM topics"),
    "friend_topic_avg": (
        _MAIN, 0,
        """SELECT id, feat, round(total / degree, 6) + 0.0 AS friend_avg
           FROM friend_sums JOIN kept USING (id) WHERE feat IN (SELECT feat FROM topics)""",
    ),
    "random_topic_avg": (
        _RANDOM, 0,
        """SELECT id, feat, round(total / least(degree, n), 6) + 0.0 AS base_avg
           FROM base_sums JOIN kept USING (id), people WHERE feat IN (SELECT feat FROM topics)""",
    ),
    "population_topic_avg": (_MAIN, 0, "SELECT feat, round(mean2, 6) + 0.0 AS base_avg FROM topics"),
    "topic_deltas": (
        _MAIN, 0, f"SELECT id, feat, {_r('tt', 'tf', 'tr')} FROM deltas WHERE s0 <> 0 OR s1 <> 0 OR friend_total <> 0",
    ),
    "topic_cosine": (_MAIN, 0, f"SELECT feat, {_r('cos_friends', 'cos_base')} FROM cosines"),
    "topic_influence": (_MAIN, 0, _COSINE_QUERY),
    "topic_influence_order_free": (
        _MAIN, 0,
        """SELECT feat, cos_friends, cos_base,
                  CASE WHEN abs(cos_friends - cos_base) < 1e-12 THEN 0 ELSE cos_friends - cos_base END AS cos_diff FROM exact_cosines""",
    ),
    "topic_influence_tercile1": (_MAIN, 1, _COSINE_QUERY),
    "topic_influence_tercile2": (_MAIN, 2, _COSINE_QUERY),
    "topic_influence_raw": ("raw_population", 0, _COSINE_QUERY),
    "topic_influence_random": (_RANDOM, 0, _COSINE_QUERY),
    "topic_influence_trust": (_TRUST, 0, _COSINE_QUERY),
    "topic_ols": (_OLS, 0, f"SELECT feat, {_r(*_FIT)}, n FROM fits"),
    "vocab_lines": (_OLS, 0, "SELECT feat AS line FROM vocabulary"),
    "influence_of_nobody": (_MAIN, 0, "SELECT 0::BIGINT AS topics, count(*) AS kept FROM degrees WHERE degree >= 1000000000"),
    "friend_coefficient": (_OLS, 0, f"SELECT feat, {_r('b_friends')} FROM fits WHERE abs(b_friends) > 0"),
    "influence_summary": (
        _MAIN, 0,
        """SELECT count(*) AS topics, round(avg(cos_friends), 6) + 0.0 AS mean_cos_friends,
                  round(avg(cos_base), 6) + 0.0 AS mean_cos_base FROM cosines""",
    ),
    "influence_above_threshold": (
        _MAIN, 0,
        f"""SELECT feat || chr(9) || ',' || chr(9) || (round(cos_friends - cos_base, 6) + 0.0)::VARCHAR AS line
            FROM cosines WHERE abs(cos_friends - cos_base) > {THRESHOLD}""",
    ),
    "ols_export_lines": (
        _OLS, 0,
        "SELECT feat || chr(9) || ':' || chr(9) || "
        + " || ".join(f"(round({name}, 6) + 0.0)::VARCHAR || chr(9)" for name in _FIT)
        + " AS line FROM fits",
    ),
    "pipeline_counts": (
        _MAIN, 0,
        " UNION ALL ".join(f"SELECT '{stage}' AS stage, count(*) AS n FROM {rows}" for stage, rows in _COUNTS.items()).format(
            min_degree=VARIANTS[_MAIN].min_degree
        ),
    ),
    "trust_scan": (
        _TRUST, 0, f"SELECT user_id, num_of_friends, {_r('wo_retweets', 'first_part', 'diff_score')} FROM trust_scores",
    ),
    "trust_core": (_TRUST, 0, "SELECT user_id AS id FROM trust_scores WHERE num_of_friends > 1"),
    "trust_friend_avg": (_TRUST, 0, "SELECT user_id, round(avg_friends + 1e-7, 3) + 0.0 AS avg_friends FROM averaged"),
    "trust_diffs": (
        _TRUST, 0,
        """SELECT t.user_id, round(a.avg_friends + 1e-7, 3) + 0.0 AS avg_friends,
                  round(p.avg_people + 1e-7, 3) + 0.0 AS avg_random_people,
                  round(a.avg_friends - t.first_part + 1e-7, 3) + 0.0 AS diff_friends,
                  round(p.avg_people - t.first_part + 1e-7, 3) + 0.0 AS diff_random_people
           FROM trust_scores t LEFT JOIN averaged a USING (user_id)
           LEFT JOIN (SELECT source_id, avg(wo_retweets) AS avg_people FROM draws JOIN trust_scores ON user_id = dest_id
                      GROUP BY source_id) p ON p.source_id = t.user_id""",
    ),
}

PREPARATION_QUERIES: dict[str, str] = {
    "ring_reach_count": f"""
        SELECT count(DISTINCT dest_id) AS reached FROM network JOIN accounts s ON source_id = s.id
        WHERE s.counter > {RING_COUNTERS[0]} AND s.counter < {RING_COUNTERS[1]} AND dest_id IN (SELECT id FROM accounts)""",
    "core_members": "SELECT dest_id FROM members",
    "core_messages": "SELECT message_id, user_id, created_at, is_rt FROM core_messages",
    "message_positions": "SELECT * FROM positions",
    "positions_after_append": "SELECT * FROM positions",
    "positions_appended": "SELECT * FROM positions",
    "accounts_reshaped": "SELECT id, level::BIGINT AS level, counter, counter <> id AS is_copy FROM accounts",
    "position_bounds": "SELECT user_id, min_, max_ FROM bounds",
    "first_positions": "SELECT * FROM positions WHERE position <= 10",
    "user_first_messages": f"""
        SELECT message_id, user_id, created_at, row_number() OVER (ORDER BY message_id) AS position
        FROM messages_nrt WHERE user_id = {FIRST_USER} QUALIFY position <= 10""",
    "first_tercile_messages": "SELECT message_id, user_id, created_at FROM tercile",
    "first_tercile_by_bounds": "SELECT * FROM tercile",
    "tercile_sizes": "SELECT user_id, count(*) AS messages FROM tercile GROUP BY user_id",
    "message_parts": "SELECT message_id, user_id, half::BIGINT AS half, third::BIGINT AS third FROM parts",
    "accounts_core": "SELECT id, username, friends_count, statuses_count FROM core_accounts",
    "accounts_inserted": "SELECT id, username, friends_count, statuses_count FROM core_accounts",
    "accounts_last_message": "SELECT * FROM enriched",
    "accounts_last_merged": "SELECT * FROM enriched",
    "network_core": "SELECT source_id, dest_id FROM core_edges",
    "edges_last_message": """
        SELECT source_id, dest_id, last_message_id, last_nrt_message_id FROM core_edges JOIN enriched ON id = source_id""",
    "edges_last_bucketed": """
        SELECT source_id, dest_id, last_message_id, last_nrt_message_id FROM core_edges JOIN enriched ON id = source_id""",
    "friend_messages": "SELECT * FROM fan_out",
    "friend_message_key_dups": """
        SELECT count(*) AS duplicate_keys
        FROM (SELECT parent_id, message_id FROM fan_out GROUP BY ALL HAVING count(*) > 1)""",
}


def _by_tercile(tercile: int) -> str:
    return compose(
        {**INPUTS, **_features(tercile)},
        f"""SELECT {tercile}::BIGINT AS tercile, slice::BIGINT AS slice, feat, count(*) AS "rows",
                   sum(value)::BIGINT AS value, round(sum(group_norm), 6) + 0.0 AS group_norm
            FROM features GROUP BY slice, feat""",
    )


def oracle_sql() -> dict[str, str]:
    queries = {
        name: compose(_study(variant, VARIANTS[variant], tercile), query)
        for name, (variant, tercile, query) in STUDY_QUERIES.items()
    }
    queries |= {name: compose(PREPARATION, query) for name, query in PREPARATION_QUERIES.items()}
    queries["features_by_tercile"] = " UNION ALL ".join(f"SELECT * FROM ({_by_tercile(t)})" for t in (0, 1, 2))
    return queries
