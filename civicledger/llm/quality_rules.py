"""Line-first cleaning, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a
document that loses too much of its text goes with them. Document-level base rules (length,
repeated three-word windows) are evaluated on the whole original text.

All work is inside one row: arrays of the row's own words and lines, no join, no shuffle, so a hot
source or a long text changes nothing but that row's cost.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicledger.llm.common import drop_columns_like

#: Fixed values. A word is a run of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line ends well with one of these, perhaps after closing marks.
CLOSING = r"['\"”’»)\]]"
TERMINAL = rf"[.!?…。！？:;]{CLOSING}*$"
#: Characters at a line's end that usually settle this.
TAIL = 64
#: Phrases of boilerplate lines, lower case, by language: English, German, French, Spanish.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "we use cookies", "click here", "sign up for our newsletter", "subscribe to our",
    "enable javascript", "lorem ipsum", "skip to content", "back to top", "follow us on",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "wir verwenden cookies", "hier klicken", "newsletter abonnieren", "zum seitenanfang", "folgen sie uns auf",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "nous utilisons des cookies", "cliquez ici", "abonnez-vous à", "haut de page", "suivez-nous sur",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utilizamos cookies", "haga clic aquí", "suscríbete a", "volver arriba", "síguenos en",
)
#: Lines that are one of these, or begin with it and a mark, are navigation; the same languages.
NAVIGATION = (
    "home", "menu", "next", "previous", "login", "share", "back", "search", "startseite", "menü", "weiter", "zurück", "anmelden", "teilen", "suche", "accueil", "suivant", "précédent", "connexion", "partager", "retour", "rechercher",
    "inicio", "menú", "siguiente", "anterior", "acceder", "compartir", "volver", "buscar",
)
NAVIGATION_LINE = rf"^({'|'.join(NAVIGATION)})( [>»|/-] .*)?$"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Shares in percent, to stay in whole numbers.
MAX_SYMBOL_PERCENT = 10
MAX_SHOUT_PERCENT = 50
MAX_LOST_PERCENT = 50
MIN_BARS = 2
#: A line without end punctuation counts as running text from so many words on.
LONG_LINE_WORDS = 12

_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "chars_removed_percent", "kept", "clean_text"]


def _trimmed(text: Column) -> Column:
    """text without white space at its ends; most texts have none, and looking is cheaper than trimming."""
    ends = F.left(text, F.lit(1)).isin(*SPACE_CHARS) | F.right(text, F.lit(1)).isin(*SPACE_CHARS)
    return F.when(ends, F.trim(text, F.lit(SPACE_CHARS))).otherwise(text)


def _count(text: Column, part: str) -> Column:
    """How often part stands in text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def _ends_well(line: Column) -> Column:
    """The line matches TERMINAL: seen at its last characters, unless these may all be closing marks."""
    tail = F.right(line, F.lit(TAIL))
    return tail.rlike(TERMINAL) | (tail.rlike(f"^{CLOSING}{{{TAIL // 2}}}") & line.rlike(TERMINAL))


def line_fails(line: Column, words: Column) -> Column:
    """True for a line of so many words, already trimmed and not empty, that a rule removes; cheap tests first."""
    low = F.lower(line)
    navigation = (_count(line, "|") >= MIN_BARS) | low.rlike(NAVIGATION_LINE)
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    punctuation = ((words < LONG_LINE_WORDS) & ~_ends_well(line)) | (symbols * 100 > MAX_SYMBOL_PERCENT * F.length(line)) | (_count(line, "!!") * 100 > MAX_SHOUT_PERCENT * words)
    boiler = reduce(or_, (low.contains(phrase) for phrase in BOILERPLATE))
    return punctuation | navigation | ((words < 4 * LONG_LINE_WORDS) & boiler)


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed,
    chars_removed_percent, kept, clean_text (the lines that pass); columns of these names are replaced.

    A null text has no words: all counts 0, base_failed, not kept, clean_text null. So does an empty
    or blank one, with clean_text empty. Repeated rows are judged alike; an empty table gives no rows.
    Equality of three-word windows within a text is equality of their 64-bit hashes.
    """
    out = drop_columns_like(docs, [*_COLUMNS, "__t", "__w", "__h", "__s", "__p", "__l", "__k"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = out.withColumn("__t", _trimmed(text))
    out = out.withColumn("__w", F.when(F.col("__t") == "", F.array().cast("array<string>")).otherwise(F.split("__t", SPACE)))
    n = F.size("__w")
    out = out.withColumn("__h", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))))
    # positions of windows found more than once: sort (hash, position), look at the neighbours
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("__p", F.sort_array(F.transform(
        F.filter("__s", lambda x, i: (F.get("__s", i + 1).h.eqNullSafe(x.h)) | ((i > 0) & F.get("__s", i - 1).h.eqNullSafe(x.h))), lambda x: x.i)))
    covered = F.aggregate(F.transform("__p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - x, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("__l", F.split(text, "\n", -1))
    worded = F.filter("__l", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("n_words", n.cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count("__t", F.lit(f"[{SYMBOLS}]")).cast("long"))
    out = out.withColumn("n_repeat_words", covered).withColumn("__l", worded)
    out = out.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("__l", F.transform("__l", _trimmed))
    counted = F.transform("__l", lambda x: F.struct(x.alias("line"), F.size(F.split(x, SPACE)).alias("words")))
    out = out.withColumn("__k", F.filter(counted, lambda x: ~line_fails(x.line, x.words)).getField("line"))
    size = lambda c: F.length(F.array_join(c, ""))
    out = out.withColumn("n_lines", F.size("__l").cast("long")).withColumn("n_lines_removed", (F.size("__l") - F.size("__k")).cast("long"))
    out = out.withColumn("chars_removed_percent", F.when(size("__l") > 0, F.floor(F.lit(100) * (size("__l") - size("__k")) / size("__l"))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("chars_removed_percent") < MAX_LOST_PERCENT))
    out = out.withColumn("clean_text", F.when(F.col(text_col).isNotNull(), F.array_join("__k", "\n")))
    return out.drop("__t", "__w", "__h", "__s", "__p", "__l", "__k")


#: The query of op1 in DuckDB.
ORACLE = """
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, list_filter(regexp_split_to_array(text, '[ \\x09-\\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) as l from d),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
p as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from g) where c > 1),
r as (select rid, sum(least(3, coalesce(nxt - i, 3)))::bigint as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from p) group by rid),
t as (select rid, list_transform(l, lambda x: regexp_replace(x, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g')) as t from w),
k as (select rid, t, list_filter(t, lambda x: not (
  length(x) - length(replace(x, '|', '')) >= 2
  or regexp_matches(lower(x), '{NAVIGATION_LINE}')
  or (not regexp_matches(x, '[.!?…。！？:;][''"”’»)\\]]*$') and len(regexp_split_to_array(x, '[ \\x09-\\x0D]+')) < 12)
  or (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 100 > 10 * length(x)
  or (length(x) - length(replace(x, '!!', ''))) / 2 * 100 > 50 * len(regexp_split_to_array(x, '[ \\x09-\\x0D]+'))
  or (regexp_matches(lower(x), '{PHRASES}')
      and len(regexp_split_to_array(x, '[ \\x09-\\x0D]+')) < 48))) as k from t),
c as (select w.rid, doc_id, len(w.w)::bigint as n_words, length(list_aggregate(w.w, 'string_agg', ''))::bigint as wc,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
  coalesce(length(list_aggregate(k.t, 'string_agg', '')), 0) as all_chars, coalesce(length(list_aggregate(k.k, 'string_agg', '')), 0) as kept_chars,
  len(k.t)::bigint as n_lines, (len(k.t) - len(k.k))::bigint as n_lines_removed
  from w join k using (rid) left join r on r.rid = w.rid),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  case when all_chars > 0 then floor(100.0 * (all_chars - kept_chars) / all_chars) else 0 end::bigint as lost from c)
select doc_id, n_words, coalesce(wc, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed,
  lost as chars_removed_percent, not base_failed and lost < 50 as kept from f
""".replace("{NAVIGATION_LINE}", NAVIGATION_LINE).replace("{PHRASES}", "|".join(BOILERPLATE).replace("'", "''"))
