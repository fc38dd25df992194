"""Quality rules: line-first cleaning with built-in expressions only.

Every line is judged (punctuation, navigation, boilerplate, runs of one word); failing lines go, and
a document that loses too much of its text goes as a whole. Navigation is a line of separated items, a short
line of menu words, or a run of short title-like lines; a heading of its own stays. All figures of a document
come from arrays inside its own row, so there is no shuffle and no hot key at any size.

Defined edge cases: null and empty texts have no words, all counts 0, and fail the base rule (fewer
than ``min_words`` words); repeated rows are judged row by row; a null id is carried along; an empty
table gives an empty result. ``quality_figures`` returns the id and its own columns only, so input
columns of the same names do no harm; ``clean_lines`` returns the input's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space between words, and the characters counted as symbols.
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Marks between the items of a menu, marks that end or part a sentence.
SEPARATORS = "|/>»«·•–—-"
SENTENCE_MARKS = ".!?…:;,。！？"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Line rules compare with the line's words, the last one with the text's characters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: punctuation and navigation: symbols (separators among them) to a hundred words of a line
    max_symbol_percent: int = 30
    #: punctuation: doubled exclamation marks to a hundred words of a line
    max_exclaim_percent: int = 30
    #: punctuation: a line of so many words without any mark that ends or parts a sentence
    min_flat_words: int = 20
    #: navigation: separators that stand alone, at least two, to a hundred words of a line
    max_separator_percent: int = 15
    #: navigation: a line of at most so many words that are menu words, two at least, to this share
    max_menu_words: int = 12
    min_menu_percent: int = 50
    #: navigation: so many title-like lines of at most so many words follow each other
    min_title_lines: int = 3
    max_title_words: int = 5
    max_title_chars: int = 80
    #: a line of ``min_run_words`` words or more fails with so few different words to a hundred
    min_run_words: int = 12
    min_distinct_percent: int = 20
    #: a line of at most so many words fails if it holds a boilerplate phrase
    max_boilerplate_words: int = 30
    #: a document goes when failed lines held more than this share of its word characters
    max_lost_percent: int = 30
    boilerplate: tuple[str, ...] = (
        "all rights reserved",
        "cookie policy",
        "privacy policy",
        "terms of service",
        "terms of use",
        "subscribe to our newsletter",
        "javascript is disabled",
        "enable javascript",
        "click here to",
        "sign up for",
        "alle rechte vorbehalten",
        "datenschutz",
        "nutzungsbedingungen",
        "tous droits réservés",
        "politique de confidentialité",
        "mentions légales",
        "todos los derechos reservados",
        "política de privacidad",
        "política de cookies",
        "aviso legal",
    )
    menu: tuple[str, ...] = (
        "home", "about", "contact", "login", "logout", "search", "menu", "news", "sitemap", "register", "help", "faq", "shop", "cart", "account", "imprint",
        "startseite", "kontakt", "anmelden", "suche", "impressum", "hilfe", "warenkorb", "accueil", "connexion", "recherche", "panier", "aide",
        "inicio", "contacto", "buscar", "ayuda", "carrito", "acceder",
    )


def _literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" if not c.isalnum() and c != " " else c for c in text) + "'"


def _words(text: str) -> str:
    """SQL for the words of a text."""
    bare = f"btrim({text}, {_literal(SPACES)})"
    return f"if({bare} = '', cast(array() as array<string>), split({bare}, '[\\\\x20\\\\x09-\\\\x0D]+'))"


def _title(rules: QualityRules) -> str:
    """Pattern of a short line whose words all begin large, without a mark at its end."""
    blank = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]*"
    return rf"^{blank}*\p{{Lu}}{word}(?:{blank}+[\p{{Lu}}0-9]{word}){{0,{rules.max_title_words - 1}}}{blank}*$"


def _figures(docs: DataFrame, text_col: str, rules: QualityRules) -> DataFrame:
    """``docs`` and, below names that start with ``__q``, its lines, their verdicts and the counts."""
    symbols = f"[{SYMBOLS}]"
    phrases = " or ".join(f"contains(low, {_literal(p)})" for p in rules.boilerplate) or "false"
    menu = "array(" + ", ".join(_literal(m) for m in rules.menu) + ")"
    title = _title(rules).replace("\\", "\\\\")
    lone = f"^[{''.join(chr(92) * 2 + c if c in '|/-' else c for c in SEPARATORS)}]+$"
    # a separator behind white space or at the beginning; whether it stands alone is seen among the words
    some = f"(^|{SPACE_CLASS[:-1].replace(chr(92), chr(92) * 2)}){lone[1:-1]}"
    ended = f"[{SENTENCE_MARKS}]{SPACE_CLASS[:-1].replace(chr(92), chr(92) * 2)}*$"
    text = f"coalesce(`{text_col}`, '')"
    df = docs.withColumn("__q_words", F.expr(_words(text))).withColumn("__q_lines", F.expr(f"split({text}, '\\n')"))
    df = df.withColumn(
        "__q_judged",
        F.expr(
            f"""transform(__q_lines, l -> struct(
                {_words("l")} as w,
                length(l) - length(regexp_replace(l, '{symbols}', '')) as symbols,
                (length(l) - length(replace(l, '!!', ''))) / 2 as exclaims,
                length(l) <= {rules.max_title_chars} and regexp_like(l, '{title}') and not regexp_like(l, '{ended}') as title))"""
        ),
    )
    df = df.withColumn(
        "__q_bad",
        F.expr(
            f"""transform(__q_judged, (j, i) -> size(j.w) > 0 and (
                (size(j.w) >= {rules.min_flat_words} and not regexp_like(get(__q_lines, i), '[{SENTENCE_MARKS}]'))
                or (regexp_like(get(__q_lines, i), '{some}') and 100 * size(filter(j.w, x -> regexp_like(x, '{lone}'))) > greatest(199, {rules.max_separator_percent} * size(j.w)))
                or (size(j.w) between 2 and {rules.max_menu_words} and 100 * size(filter(j.w, x -> array_contains({menu}, lower(x))))
                    >= greatest(200, {rules.min_menu_percent} * size(j.w)))
                or (j.title and exists(sequence(0, {rules.min_title_lines - 1}), k -> i >= k
                    and forall(sequence(0, {rules.min_title_lines - 1}), m -> coalesce(get(__q_judged, cast(i - k + m as int)).title, false))))
                or 100 * j.symbols > {rules.max_symbol_percent} * size(j.w)
                or 100 * j.exclaims > {rules.max_exclaim_percent} * size(j.w)
                or (size(j.w) >= {rules.min_run_words}
                    and 100 * size(array_distinct(j.w)) < {rules.min_distinct_percent} * size(j.w))
                or (size(j.w) <= {rules.max_boilerplate_words} and exists(array(lower(get(__q_lines, i))), low -> {phrases}))))"""
        ),
    )
    # Windows as packed longs, the hash above the position, which the JVM sorts as primitives.
    df = df.withColumn("__q_low", F.expr("shiftleft(1L, cast(ceil(log2(size(__q_words) + 1)) as int))"))
    df = df.withColumn(
        "__q_packed",
        F.expr(
            """sort_array(if(size(__q_words) < 3, cast(array() as array<bigint>),
                transform(sequence(0, size(__q_words) - 3), i ->
                    (xxhash64(get(__q_words, i), get(__q_words, i + 1), get(__q_words, i + 2)) & -__q_low) | i)))"""
        ),
    )
    # Only windows whose hash has a twin are compared as text, so the count is exact.
    df = df.withColumn(
        "__q_twins",
        F.expr(
            """sort_array(transform(filter(__q_packed, (x, k) ->
                (k > 0 and (get(__q_packed, k - 1) & -__q_low) = (x & -__q_low))
                or coalesce((get(__q_packed, k + 1) & -__q_low) = (x & -__q_low), false)),
                x -> struct(concat_ws(' ', slice(__q_words, cast(x & (__q_low - 1) as int) + 1, 3)) as w,
                            cast(x & (__q_low - 1) as int) as i)))"""
        ),
    )
    df = df.withColumn(
        "__q_repeats",
        F.expr(
            """size(array_distinct(flatten(transform(filter(__q_twins, (x, k) ->
                (k > 0 and get(__q_twins, k - 1).w = x.w) or coalesce(get(__q_twins, k + 1).w = x.w, false)),
                x -> array(x.i, x.i + 1, x.i + 2)))))"""
        ),
    )
    df = df.withColumn("__q_full", F.expr("transform(filter(arrays_zip(__q_lines, __q_judged), z -> size(z.__q_judged.w) > 0), z -> z.__q_lines)"))
    df = df.withColumns(
        {
            "__q_n": F.expr("cast(size(__q_words) as bigint)"),
            "__q_chars": F.expr("cast(length(array_join(__q_words, '')) as bigint)"),
            "__q_symbols": F.expr("cast(aggregate(__q_judged, 0, (n, j) -> n + j.symbols) as bigint)"),
            "__q_dups": F.expr("cast(size(__q_full) - size(array_distinct(__q_full)) as bigint)"),
            "__q_lost": F.expr(
                """cast(aggregate(arrays_zip(__q_judged, __q_bad), 0,
                    (s, z) -> s + if(z.__q_bad, length(array_join(z.__q_judged.w, '')), 0)) as bigint)"""
            ),
        }
    )
    df = df.withColumn(
        "__q_failed",
        F.expr(f"__q_n < {rules.min_words} or 100 * __q_repeats > {rules.max_repeat_percent} * __q_n"),
    )
    return df.withColumn("__q_kept", F.expr(f"not __q_failed and 100 * __q_lost <= {rules.max_lost_percent} * __q_chars"))


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: the counts, the base rule and the verdict."""
    df = _figures(docs.select(F.col(id_col), F.col(text_col)), text_col, rules)
    return df.select(
        F.col(id_col),
        F.col("__q_n").alias("n_words"),
        F.col("__q_chars").alias("word_chars"),
        F.col("__q_symbols").alias("n_symbols"),
        F.col("__q_dups").alias("n_dup_lines"),
        F.col("__q_repeats").cast("bigint").alias("n_repeat_words"),
        F.col("__q_failed").alias("base_failed"),
        F.col("__q_kept").alias("kept"),
    )


def clean_lines(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The kept documents without their failed lines; the columns of the input, the text cleaned."""
    judged = _figures(docs, text_col, rules)
    text = F.expr("array_join(transform(filter(arrays_zip(__q_lines, __q_bad), z -> not z.__q_bad), z -> z.__q_lines), '\n')")
    judged = judged.withColumn("__q_text", F.when(F.expr("exists(__q_bad, b -> b)"), text).otherwise(F.col(text_col)))
    # a generator, not a filter: a filter would be pushed below the arrays, which would then be built over and over
    kept = judged.select("*", F.explode(F.expr("if(__q_kept, array(struct(__q_text as t)), array())")).alias("__q_one"))
    return kept.select(*[F.col("__q_one.t").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op8(spark, sf_dir):
    from kinweave.session import table

    return quality_figures(table(spark, sf_dir, "documents"))


def oracle(rules: QualityRules = QualityRules()) -> str:
    """DuckDB SQL for ``op8``."""
    phrases = " or ".join(f"contains(lower(l), '{p}')" for p in rules.boilerplate)
    menu = ", ".join(f"'{m}'" for m in rules.menu)
    n = rules.min_title_lines

    def at(d: int) -> str:
        return "true" if not d else f"coalesce({'lag' if d < 0 else 'lead'}(title, {abs(d)}) over o, false)"

    runs = " or ".join("(" + " and ".join(at(m - k) for m in range(n)) + ")" for k in range(n))
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, string_split(text, chr(10)) as lines from t),
pos as (select doc_id, words, unnest(generate_series(1, len(words) - 2)) as i from w where len(words) >= 3),
win as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from pos),
twin as (select doc_id, i, count(*) over (partition by doc_id, g) as n from win),
cov as (select distinct doc_id, i + d as p from twin, (values (0), (1), (2)) as v(d) where n > 1),
rep as (select doc_id, count(*) as n_repeat_words from cov group by doc_id),
ln as (select doc_id, unnest(lines) as l, unnest(generate_series(1, len(lines))) as i from w),
lt as (select doc_id, l, i, coalesce(length(l) <= {rules.max_title_chars} and regexp_matches(l, '{_title(rules)}') and not regexp_matches(l, '[{SENTENCE_MARKS}]{SPACE_CLASS[:-1]}*$'), false) as title from ln),
lr as (select *, title and ({runs}) as run from lt window o as (partition by doc_id order by i)),
lw as (select doc_id, l, run, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') as lw, regexp_extract_all(lower(l), '[^\\x20\\x09-\\x0D]+') as lo,
       regexp_matches(l, '[{SENTENCE_MARKS}]') as marked,
       length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) as sy,
       (length(l) - length(replace(l, '!!', ''))) / 2 as ex, ({phrases}) as ph from lr),
lj as (select doc_id, l, len(lw) as n, length(array_to_string(lw, '')) as chars,
       (run or (len(lw) >= {rules.min_flat_words} and not marked)
        or (len(list_filter(lw, lambda x: regexp_full_match(x, '[|/>»«·•–—-]+'))) >= 2 and 100 * len(list_filter(lw, lambda x: regexp_full_match(x, '[|/>»«·•–—-]+'))) > {rules.max_separator_percent} * len(lw))
        or (len(lw) between 2 and {rules.max_menu_words} and 100 * len(list_filter(lo, lambda x: list_contains([{menu}], x))) >= greatest(200, {rules.min_menu_percent} * len(lw)))
        or 100 * sy > {rules.max_symbol_percent} * len(lw) or 100 * ex > {rules.max_exclaim_percent} * len(lw)
        or (len(lw) >= {rules.min_run_words} and 100 * len(list_distinct(lw)) < {rules.min_distinct_percent} * len(lw))
        or (ph and len(lw) <= {rules.max_boilerplate_words})) as bad from lw where len(lw) > 0),
la as (select doc_id, count(*) - count(distinct l) as n_dup_lines, sum(case when bad then chars else 0 end) as lost from lj group by doc_id),
f as (select w.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
      coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost
      from w left join rep using (doc_id) left join la using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) as base_failed,
       not (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
       and 100 * lost <= {rules.max_lost_percent} * word_chars as kept
from f"""
