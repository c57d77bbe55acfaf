"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a caption, a heading or a reference list looks like.
CAPTION_WORDS = r"Fig(?:ure)?s?\.?|Scheme|Table|Tab\.?|図|表"
CAPTION_HEAD = (
    r"^\s*(?:<[^>]+>\s*)*(?:(?i:supplementary)\s+|(?i:suppl?)\.?\s+|補足\s*|副\s*)?((?i:Fig(?:ure)?s?\.?|Scheme|Table|Tab\.?)|図|表)\s*"
    r"([Ss]?[0-9]+[A-Za-z]?(?:[-–][Ss]?[0-9]+[A-Za-z]?)?)(?:\s*[.:：|]|\s+[A-Z]|\s*$)"
)
CAPTION_START = r"^(?i:(?:supplementary\s+|extended\s+data\s+)?(?:fig(?:ure)?s?\.?|table|図|表)\s*S?[0-9])"
LEGEND_MARK = r"((?i:Fig(?:ure)?s?\.?|Scheme|Table|Tab\.?)|図|表)\s*([Ss]?[0-9]+[A-Za-z]?)\s*[.:：]\s*"
REFERENCES_START = r"^(?i:references?|bibliography|参考文献)[\s.:：]*$"
REFERENCES_END = (
    r"^(?i:acknowledg\w*|author\s+contributions?|competing\s+interests?|conflict\s+of\s+interests?|data\s+availability|code\s+availability|funding|"
    r"ethics?\s+statement|figure\s+legends?|figure\s+captions?|methods?(?:\s+and\s+materials?)?|materials?(?:\s+and\s+methods?)?|online\s+methods|"
    r"star\s*methods|experimental\s+(?:section|procedures?|methods?)|supplement(?:ary)?(?:\s+(?:information|material|data|figures?|tables?))?|appendix|"
    r"附録|補足|謝辞|利益相反|著者貢献|方法|材料と方法|実験方法|実験手順)[\s.:：]*$"
)
ABBREVIATIONS = ("Fig", "Figs", "Eq", "Eqs", "Sec", "Secs", "Ref", "Refs", "Vol", "Vols", "No", "Nos", "pp", "Ch", "Chs", "App", "Prop", "Thm", "Lem", "Def", "Cor", "approx", "ca")
HALLUCINATION_MARKERS = ("(ブロック", "ブロック0の翻訳", "翻訳のみ", "原文の再掲", "本研究では、新規の", "有機金属化合物", "空間群 P2", "磁性材料")
SCRIPTS = {"ja": "[ぁ-んァ-ヴ一-龥]", "zh": "[一-鿿]", "ko": "[가-힯]"}
LANGUAGES = ("ja", "en", "zh", "ko", "de", "fr", "es")
MARK = "\u0001"
#: White space as RE2 and so the SQL has it; Java's class also has the vertical tab. And Unicode's space separators, which SQL's trim takes off.
SPACE = r"\t\n\f\r "
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def trim_separators(c: Column) -> Column:
    return F.trim(c, F.lit(SEPARATORS))


def plain(c: Column) -> Column:
    """Without markup, white space runs as one space, trimmed; a null is empty."""
    text = F.coalesce(c, F.lit(""))
    bare = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", "")).otherwise(text)
    return trim_separators(F.regexp_replace(bare, rf"[{SPACE}]+", " "))


def simple_lower(c: Column) -> Column:
    """Each code point in small by itself, as SQL has it: Σ becomes σ at the end of a word too, İ becomes i."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def simple_upper(c: Column) -> Column:
    """Each code point in capitals by itself, as SQL has it: those that would become several, such as ß, stay."""
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.when(c.rlike("[ßŉǰΐΰև\u1e96-\u1e9a\u1f50-\u1fff\ufb00-\ufb17]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(F.upper(c))


def shield_abbreviations(c: Column) -> Column:
    """Full stops of abbreviations and initials as NUL, so that no sentence ends there; lengths stay."""
    known = F.regexp_replace(c, r"\b(" + "|".join(ABBREVIATIONS) + r")\.", "$1\u0000")
    return F.regexp_replace(known, r"\b([A-Z])\.(?=\s+[a-z])", "$1\u0000")


def sentence_pieces(c: Column) -> Column:
    """The text cut where a sentence may begin; the pieces' concatenation is the text.

    A cut stands after . ! ? with closers and white space, or right before a capital after two small letters; after
    full-width stops always. An initial ends no sentence: such pieces are joined with what follows.
    """
    close = r"[\"'”’)\]]*(?:<sup>[^<]{0,40}</sup>)?(?:</(?:i|b|sup|sub)>)?"
    cut = F.regexp_replace(c, rf"(?:[.!?]{close}\s+|(?<=[a-z]{{2}})[.!?]{close}(?=[A-Z])|[。！？]\s*)(?=\S)", "$0" + MARK)
    # no cut after an initial; of initials in a row every other one is found, so twice
    for _ in range(2):
        cut = F.regexp_replace(cut, rf"((?:^|[\s(\[.\-{MARK}])[A-Z]\.{close}\s*){MARK}", "$1")
    return F.filter(F.split(cut, MARK), lambda p: p != "")


def spaced_pieces(c: Column) -> Column:
    """H1's first branch, the rule of PIECE_SQL to the letter: a cut stands after . ! ? with closers and white space only.

    The character after a cut is taken with it, so a stop that stands there begins no cut of its own (". . x" has one). Initials are found
    in one pass, so of several in a row every other one ends a piece; `sentence_pieces` joins them all. White space is RE2's, without the
    vertical tab, and an empty text is one empty piece.
    """
    close = r"[\"'”’)\]]*(?:<sup>[^<]{0,40}</sup>)?(?:</(?:i|b|sup|sub)>)?"
    cut = F.regexp_replace(c, rf"([.!?]{close}[{SPACE}]+)([^{SPACE}])", f"$1{MARK}$2")
    return F.split(F.regexp_replace(cut, rf"((?:^|[{SPACE}(\[.\-{MARK}])[A-Z]\.[{SPACE}]*){MARK}", "$1"), MARK)


def caption_head(c: Column) -> Column:
    """Struct (word, kind, number) of a caption's head; null fields if the text is none."""
    word, number = F.regexp_extract(c, CAPTION_HEAD, 1), F.regexp_extract(c, CAPTION_HEAD, 2)
    kind = F.when(F.lower(F.substring(word, 1, 3)).isin("tab") | (word == "表"), "table").otherwise("figure")
    return F.when(word != "", F.struct(word.alias("word"), kind.alias("kind"), number.alias("number")))


def base_number(number: Column, supplement: Column) -> Column:
    """Without the panel letter, small, with an s in front if the document is a supplement."""
    bare = F.regexp_replace(F.lower(number), "[a-z]$", "")
    return F.when(supplement & ~bare.startswith("s"), F.concat(F.lit("s"), bare)).otherwise(bare)


def untranslated(target: Column, source: Column, lang: Column) -> Column:
    def squeeze(c: Column) -> Column:
        return simple_lower(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), rf"[{SPACE}]+", ""))

    t, s = squeeze(target), squeeze(source)
    same = (t == s) | ((F.length(s) >= 20) & (F.substring(t, 1, 40) == F.substring(s, 1, 40)))
    foreign = F.lit(False)
    for code, script in SCRIPTS.items():
        foreign = foreign | ((lang == code) & ~target.rlike(script))
    return (t != "") & (s != "") & (same | foreign)


def hallucinated(answer: Column, source_length: Column, markers: tuple[str, ...] = HALLUCINATION_MARKERS) -> Column:
    """An answer that holds a marker (none of which begins or ends with white space) or is far longer than its source."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | answer.contains(m)
    # the trimmed text is no longer than the text, so most are never trimmed
    most = source_length * 3 + 100
    long = (source_length > 0) & (F.length(answer) > most) & (F.length(trim(answer)) > most)
    return (F.coalesce(answer, F.lit("")) != "") & (marked | long)


def is_japanese(c: Column) -> Column:
    return F.substring(c, 1, 200).rlike("[぀-ヿ一-鿿]")


def output_budget(n: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(n * 2 / 3))).cast("long")


def citation(page: Column, sentence: Column, first: Column, last: Column) -> Column:
    """[P3S12], with :L10 or :L10-12 where margin lines are known."""
    lines = F.when(first.isNull(), "").when(first == last, F.concat(F.lit(":L"), first)).otherwise(F.concat(F.lit(":L"), first, F.lit("-"), last))
    return F.concat(F.lit("[P"), page, F.lit("S"), sentence, lines, F.lit("]"))


def strip_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?(</think>|$)", "")


def strip_fence(c: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_answer(c: Column) -> Column:
    """The JSON object in a model's answer, as a variant: from the first brace to the last, or else the first pair of braces with none inside.

    Null if neither can be parsed.
    """
    whole, short = (F.try_parse_json(F.nullif(F.regexp_extract(c, p, 0), F.lit(""))) for p in (r"(?s)\{.*\}", r"\{[^{}]*\}"))
    return F.coalesce(whole, short)


def cut_off(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def wrap_styles(text: Column, styles: Column) -> Column:
    for style, tag in (("italic", "i"), ("bold", "b"), ("super", "sup"), ("sub", "sub")):
        text = F.when(F.array_contains(styles, style), F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)
    return text


def span_styles(flags: Column, font: Column, size: Column, base: Column, y_mid: Column, line_mid: Column, text: Column | None = None) -> Column:
    """Styles of a span, the inner first. A size of 0 or null counts as the base, null flags as 0; a span whose text is given and blank has none."""
    flags = F.coalesce(flags, F.lit(0))
    raised = flags.bitwiseAND(1) > 0
    size = F.coalesce(F.nullif(size, F.lit(0.0)), base)
    solid = F.lit(True) if text is None else F.coalesce(text.rlike(r"\S"), F.lit(False))
    small = ~raised & (size < base * 78 / 100)  # 10 * 0.78 is a little over 7.8
    styles = F.array_compact(
        F.array(
            F.when((flags.bitwiseAND(2) > 0) | font.rlike("[Ii]talic|[Oo]blique"), "italic"),
            F.when((flags.bitwiseAND(16) > 0) | font.rlike("[Bb]old|BOLD|Black|Heavy|Semi[Bb]old|Demi"), "bold"),
            F.when(raised | (small & (y_mid - line_mid < base * F.lit(-0.1))), "super"),
            F.when(small & (y_mid - line_mid > base * F.lit(0.1)), "sub"),
        )
    )
    return F.when(solid, styles).otherwise(F.array().cast("array<string>"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    steps = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.size(F.filter(steps, lambda n: (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)) & (F.length(a) >= n) & (F.length(b) >= n))).cast("long")
