"""The SQL of the queries on sections: the grammar of headings over rows of lines and pieces, for DuckDB."""

from __future__ import annotations

import re

from lectern.operators import headings as H
from lectern.operators.sections import HEADINGS, MAJOR, TITLES

#: Signs that part a heading's words from what is around it, and begin and end it; RE2 can't look around.
GAP, OPEN, SHUT = "chr(3)", "chr(1)", "chr(2)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapsed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def tidy(text: str) -> str:
    """Spaced headings closed up, the longest first."""
    for heading in sorted((h for h in HEADINGS if len(re.sub("[^A-Z]", "", h)) >= 4 and re.sub("[^A-Z]", "", h).isalpha()), key=len, reverse=True):
        text = rf"regexp_replace({text}, '(?i)\b{r'\s+'.join(re.sub('[^A-Z]', '', heading))}\b', '{heading}', 'g')"
    return collapsed(text)


def canonical(found: str) -> str:
    cases = " ".join(f"WHEN '{re.sub('[^A-Z0-9]', '', h)}' THEN '{h}'" for h in HEADINGS)
    return f"CASE regexp_replace(upper({found}), '[^A-Z0-9]', '', 'g') {cases} END"


def _rules() -> str:
    cases = []
    for rule in TITLES:
        some = [f"list_contains(string_split(title, ' '), '{t}')" if rule.whole else f"contains(title, '{t}')" for t in rule.terms]
        asked = f"({' OR '.join(some)})" + (f" AND contains(title, '{rule.also}')" if rule.also else "")
        cases.append(f"WHEN {'' if rule.numbered is None else 'numbered AND ' if rule.numbered else 'NOT numbered AND '}{asked} THEN '{rule.heading}'")
    cases += [f"WHEN numbered AND major = '{n}' THEN '{h}'" for n, h in MAJOR.items()]
    return " ".join(cases)


def chunks(pages: str, key: str, size: int = 900, step: int = 780) -> str:
    """Rows of the windows of ``pages``, SQL that gives (key, t)."""
    alone, numbered = _quoted(H.ALONE), _quoted(H.NUMBERED)
    spaced = "|".join(re.sub("([^A-Za-z0-9])", r"\1\\x03", h) for h in sorted(HEADINGS, key=len, reverse=True))
    inner = _quoted(rf"(?i)(^|\x03)({spaced})([^A-Za-z0-9]|$)")
    parted = rf"regexp_replace(text, '([^A-Za-z0-9])', '\1' || {GAP}, 'g')"
    head = "split_part(piece, chr(2), 1)"
    return rf"""
WITH sources AS MATERIALIZED ({pages}),
cut AS (SELECT {key}, string_split_regex(coalesce(t, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM sources),
numbered_lines AS (SELECT {key}, unnest(range(1, len(l) + 1)) AS i, regexp_replace(unnest(l), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS line FROM cut),
lines AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) AS i, line, regexp_extract(line, {alone}, 1) AS alone, {tidy("line")} AS f
          FROM numbered_lines WHERE line <> ''),
titles AS (SELECT *, regexp_matches(f, {numbered}) AS numbered, regexp_extract(f, '^\s*(\d+)', 1) AS major,
           array_to_string(regexp_extract_all(lower(CASE WHEN regexp_matches(f, {numbered}) THEN regexp_extract(f, {numbered}, 2) ELSE f END), '[a-z0-9]+'), ' ') AS title FROM lines),
told AS (SELECT {key}, i, line, len(string_split_regex(line, '\s+')) AS words, CASE WHEN alone <> '' THEN {canonical("alone")}
           WHEN length(f) = 0 OR length(f) > 110 OR contains(f, '....') OR regexp_matches(f, {_quoted(H.CAPTION)}) OR NOT numbered AND regexp_matches(f, '[.!?]$') THEN NULL
           {_rules()} END AS heading FROM titles),
grouped AS MATERIALIZED (SELECT *, sum((heading IS NOT NULL OR i = 1)::INT) OVER (PARTITION BY {key} ORDER BY i) AS g, bool_or(heading IS NOT NULL) OVER (PARTITION BY {key}) AS titled FROM told),
by_lines AS (SELECT {key}, g, {tidy("string_agg(CASE WHEN heading IS NULL THEN line ELSE regexp_replace(line, ':+$', '') END, ' ' ORDER BY i)")} AS text,
             first(heading ORDER BY i) AS heading, sum(words) AS words FROM grouped WHERE titled GROUP BY {key}, g),
placed AS (SELECT {key}, g, text, heading, coalesce(sum(words) OVER (PARTITION BY {key} ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM by_lines),
parts AS MATERIALIZED (
  SELECT {key}, g, text, heading, start, true AS titles, {parted} AS p FROM placed WHERE text <> ''
  UNION ALL
  SELECT {key}, 0, text, NULL, 0, len(list_filter(regexp_extract_all(p, {inner}, 2), lambda h: h = upper(h))) >= 2, p FROM (SELECT *, {parted} AS p FROM (
    SELECT {key}, {tidy("coalesce(t, '')")} AS text FROM sources WHERE {key} NOT IN (SELECT {key} FROM grouped WHERE titled)) WHERE text <> '')),
split AS (SELECT {key}, g, heading, start, titles, string_split(replace(regexp_replace(p, {inner}, '\1' || {OPEN} || '\2' || {SHUT} || '\3', 'g'), {GAP}, ''), {OPEN}) AS pieces FROM parts),
pieces AS (SELECT {key}, g, heading, start, titles, unnest(range(1, len(pieces) + 1)) AS j, unnest(pieces) AS piece FROM split),
marked AS (SELECT *, j > 1 AND ({head} = upper({head}) OR titles AND contains({canonical(head)}, ' ')
             AND len(list_filter(string_split_regex({head}, '[\s&]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[A-Z]'))) = 0) AS mark FROM pieces),
runs AS (SELECT *, sum((mark OR j = 1)::INT) OVER (PARTITION BY {key}, g ORDER BY j) AS r FROM marked),
raws AS (SELECT {key}, g, r, any_value(heading) AS outer_heading, any_value(start) AS start, string_agg(replace(piece, {SHUT}, ''), '' ORDER BY j) AS raw,
           first(CASE WHEN mark THEN {canonical(head)} END ORDER BY j) AS own FROM runs GROUP BY {key}, g, r),
ahead AS (SELECT *, coalesce(string_agg(raw, '') OVER (PARTITION BY {key}, g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prefix FROM raws),
sections AS (SELECT {key}, g, r, trim(raw) AS text, start + len(list_filter(string_split(prefix, ' '), lambda w: w <> '')) AS start,
             coalesce(own, CASE WHEN row_number() OVER (PARTITION BY {key}, g ORDER BY r) = 1 THEN outer_heading END) AS heading FROM ahead WHERE trim(raw) <> ''),
windows AS (SELECT {key}, g, r, heading, start, w, unnest(range(0, len(w), {step})) AS pos FROM (SELECT *, string_split(text, ' ') AS w FROM sections)),
texts AS (SELECT {key}, g, r, pos, heading, (start + pos)::INTEGER AS word_start, (start + pos + len(w[pos + 1 : pos + {size}]))::INTEGER AS word_end, array_to_string(w[pos + 1 : pos + {size}], ' ') AS text FROM windows),
usable AS (SELECT *, len(regexp_extract_all(text, '\.{{4,}}')) AS leaders,
             len(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)*\.?\s+[A-Za-z][A-Za-z0-9 &:/,\-–]{{2,90}}\s+\.{{4,}}\s+[0-9]+\b')) AS entries
           FROM texts WHERE len(regexp_extract_all(text, '[A-Za-z0-9]+')) >= 4 AND len(regexp_extract_all(text, '[A-Za-z]')) >= 16)
SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY g, r, pos) - 1)::INTEGER AS chunk_on_page, word_start, word_end, heading AS section_heading,
       round_even(len(regexp_extract_all(text, '[A-Za-z]')) / length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE, 4) AS text_density, text FROM usable
WHERE NOT (leaders > 0 AND (contains(lower(text), 'table of contents') OR entries >= 2
  OR leaders >= 2 AND regexp_matches(lower(text), '\b(?:contents|overview|objective|design|method|result|pipeline|verification)\b')))"""
