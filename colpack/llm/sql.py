"""Oracle SQL (DuckDB) of the queries that SQL can express.

Byte-pair merging, packing, SimHash, chaining, expectation-maximisation, Feistel rounds, spectra and
grammar inference are beyond it; tests hold those queries against brute force.
"""

import math

from colpack.llm.licenses import LOWER, PHRASES, SEPARATORS, TEMPLATES, THRESHOLD, UPPER


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SEPARATORS}'), lambda w: w <> '')"


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def license_scans() -> str:
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        stand = " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        places.append(f"list_transform(list_filter(range(0, len(ws) - {len(parts) - 1}), lambda i: {stand}), lambda i: {{'place': i, 'label': '{label}'}})")
    shares = []
    for k, (template, label) in enumerate(TEMPLATES.items()):
        words = [*dict.fromkeys(template.split())]
        need = math.ceil(THRESHOLD * len(words))
        step = len(template.split())
        stretches = f"list_transform(range(0, len(ws), {step}), lambda i: ws[i + 1 : i + {2 * step}])"
        shares.append((f"list_max(list_transform(blocks || {stretches}, lambda b: len(list_intersect(b, {_listed(words)}))))", need, len(words), label, f"c{k}"))
    counted = ", ".join(f"{most} AS {name}" for most, _, _, _, name in shares)
    met = " || ".join(f"CASE WHEN {name} >= {need} THEN ['{label}'] ELSE [] END" for _, need, _, label, name in shares)
    best = ", ".join(f"CASE WHEN {name} >= {need} THEN {name} / {n}::DOUBLE ELSE 0 END" for _, need, n, _, name in shares)
    return f"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
cut AS (SELECT doc_id, {_words('low')} AS ws, list_transform(string_split(low, chr(10)), lambda x: {_words('x')}) AS blocks FROM folded),
found AS (SELECT doc_id, len(ws) AS n_words, {' || '.join(places)} AS places, {counted} FROM cut),
named AS (SELECT *, list_transform(places, lambda p: p.label) AS base, list_transform(places, lambda p: p.place) AS starts FROM found)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || {met})), ','), '') AS labels,
  (CASE WHEN len(places) > 0 THEN 1.0 ELSE greatest({best}) END)::DOUBLE AS score
FROM named"""


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scans": license_scans()}
