"""DuckDB SQL for the llm queries that SQL can express."""

from __future__ import annotations

import re
import sys
import unicodedata

from loomline.llm.lookalike import skeleton

FREQUENT = """WITH c AS (SELECT {groups}, {item} AS item, count(*) AS n_rows FROM (SELECT *, strftime(seen_at, '%Y-%m-%d') AS day FROM label_log) WHERE {known} GROUP BY ALL),
t AS (SELECT *, sum(n_rows) OVER (PARTITION BY {groups})::BIGINT AS group_rows FROM c)
SELECT {out} FROM t WHERE n_rows * {den} >= group_rows"""


def looks(text: str) -> str:
    """SQL of a text whose equality is that of looks: letter by letter, without the choice of a spelling."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LNPS" and not 0xD800 <= cp < 0xE000:
            to = unicodedata.normalize("NFC", skeleton(ch))
            if to != unicodedata.normalize("NFC", ch):
                (one if len(to) == 1 else more)[ch] = to
    sql = f"regexp_replace(regexp_replace({text}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x{{034F}}]', '', 'g'), '[\\p{{Zs}}\\t]', ' ', 'g')"
    for ch, to in more.items():
        if cp_in_use(ch):
            sql = f"replace({sql}, '{ch}', '{to.replace("'", "''")}')"
    return f"nfc_normalize(translate(nfc_normalize({sql}), '{''.join(one)}', '{''.join(one.values()).replace("'", "''")}'))"


def cp_in_use(ch: str) -> bool:
    """Joined letters and Roman numerals; other characters that look like several are left to the operator."""
    return re.match("[ﬀ-ﬆⅠ-ⅿ]", ch) is not None


def p8_found() -> str:
    words = f"regexp_extract_all(replace(replace(lower({looks('text')}), 'ς', 'σ'), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
    runs = lambda t, k: f"SELECT DISTINCT {k}, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT {k}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {k}, {words} AS w FROM {t} WHERE text IS NOT NULL) WHERE len(w) >= 13)"
    return f"SELECT DISTINCT doc_id, item_id FROM ({runs('documents', 'doc_id')}) JOIN ({runs('eval_items', 'item_id')}) USING (run)"


def p9_found() -> str:
    return f"WITH l AS (SELECT doc_id, text, {looks('text')} AS look FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM l a JOIN l b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text"


def p9_classes() -> str:
    return f"WITH l AS (SELECT doc_id, text, {looks('text')} AS look FROM documents WHERE text IS NOT NULL), c AS (SELECT look, min(doc_id) AS class_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT text) AS n_texts FROM l GROUP BY look) SELECT doc_id, class_id, n_docs, n_texts FROM l JOIN c USING (look)"


SQL = {
    "p4_found": FREQUENT.format(groups="day, label_name", item="label_value", known="label_value <> '' AND label_name IS NOT NULL AND seen_at IS NOT NULL", den=100, out="day, label_name, item AS label_value"),
    "p4_values": FREQUENT.format(groups="label_name", item="label_value", known="label_value <> '' AND label_name IS NOT NULL", den=1000, out="label_name, item, n_rows, group_rows"),
    "p4_series": FREQUENT.format(groups="day", item="series_id", known="series_id IS NOT NULL AND seen_at IS NOT NULL", den=10_000, out="day, item, n_rows, group_rows"),
    "p8_found": p8_found(),
    "p9_found": p9_found(),
    "p9_classes": p9_classes(),
}
