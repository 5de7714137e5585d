"""Text expressions; all of them stay in the JVM."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.options import BLANK_CELL_PHRASES, FOOTER_CRUMBS, FOOTER_NOISE, NAME_PHRASES, PRODUCTS, SCALES, THAI_FAST_SCALES

THAI = "\\u0E00-\\u0E7F"
SPACE = r"(?U)\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(text, cls: str) -> Column:
    """How many characters are in the class."""
    return F.length(F.regexp_replace(_col(text), f"[^{cls}]", ""))


def thai_count(text) -> Column:
    return count_of(text, THAI)


def strip_(text) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def thai_density(text) -> Column:
    """Thai characters over the trimmed length; 0 for a blank text."""
    n = F.length(strip_(text))
    return F.when(n > 0, thai_count(text) / n).otherwise(0.0)


def richness(text) -> Column:
    return thai_count(text) + F.length(strip_(text))


def norm_key(text) -> Column:
    return F.regexp_replace(_col(text), SPACE, "")


def arabic_digits(text) -> Column:
    return F.translate(_col(text), "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def fix_thai_spacing(text) -> Column:
    return F.regexp_replace(_col(text), f"(?U)(?<=[{THAI}])[^\\S\\n]+(?=[{THAI}])", "")


def clean_text(text) -> Column:
    """Control and zero-width characters go, Thai digits become ASCII, rules of signs go, blanks collapse, lines are
    trimmed, and blank ones go. In Thai text, spaces and repeated marks go and split vowels are put together.

    Canonical composition is not part of it: `compose` is a pandas function for the rows that need it. Junk lexicons are
    the caller's.
    """
    t = F.regexp_replace(_col(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\u200b\u200c\u200d\ufeff]", "")
    t = F.array_join(F.filter(F.split(arabic_digits(t), "\n"), lambda x: ~x.rlike(r"(?U)^[\s_\-]{4,}$")), "\n")
    t = fix_thai_spacing(t)
    t = F.regexp_replace(t, "([\u0E31\u0E34-\u0E3A\u0E47-\u0E4E])\\1+", "$1")
    t = F.replace(F.replace(t, F.lit("\u0E4D\u0E32"), F.lit("\u0E33")), F.lit("\u0E40\u0E40"), F.lit("\u0E41"))
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), strip_), lambda x: x != ""), "\n")


def join_lines(text) -> Column:
    return F.array_join(F.transform(F.split(_col(text), "\n"), strip_), "")


def marker_key(text) -> Column:
    """S and the section number, else L and the list number, else null."""
    section = F.regexp_extract(_col(text), r"^\s*(\d{1,2}\.\d{1,2})\b", 1)
    item = F.regexp_extract(_col(text), r"^\s*(\d{1,2})\s*[.)]", 1)
    return F.when(section != "", F.concat(F.lit("S"), section)).when(item != "", F.concat(F.lit("L"), item))


def valid_marker(token) -> Column:
    """N) up to 30, X.Y and N. up to 20."""
    number = lambda p, g: F.nullif(F.regexp_extract(_col(token), p, g), F.lit("")).cast("int")
    pair = r"^(\d{1,2})\.(\d{1,2})$"
    ok = [number(r"^(\d{1,2})\)$", 1).between(1, 30), number(r"^(\d{1,2})\.$", 1).between(1, 20), number(pair, 1).between(1, 20) & number(pair, 2).between(1, 20)]
    return F.coalesce(*ok, F.lit(False))


def is_stub(text) -> Column:
    t = strip_(text)
    return (F.length(t) <= 14) & t.rlike(r"^\d{1,2}(?:[.)]\d{0,2})?[.)]?\s*$")


# How section headings, a numbered chart caption, an appendix and a glossary begin.
HEADER = r"^(\d{1,2}\.\d{1,2}\s+\S|\d{1,2}\.\s+\S|\d{1,2}\)\s*แผนภูมิ|ภาคผนวก\s|อภิธานศัพท์$)"


def is_header(text) -> Column:
    """Up to 90 characters that begin like a section, a numbered chart caption, an appendix or a glossary."""
    t = strip_(text)
    return (t != "") & (F.length(t) <= 90) & t.rlike(HEADER)


def text_layer_reliable(text, thai: bool = False) -> Column:
    """Whether a text layer can be trusted: few replacement characters, letters enough, healthy Latin if no Thai is found."""
    t = F.coalesce(_col(text), F.lit(""))
    n = F.length(t)
    broken, letters = count_of(t, "\\uFFFD"), count_of(t, "\\p{L}")
    base = (F.length(strip_(t)) > 0) & (broken <= n * 0.05) & (letters >= n * 0.25)
    if not thai:
        return base
    latin = (letters >= 40) & (letters >= n * 0.55) & (count_of(t, "0-9") <= n * 0.12) & (count_of(t, ")") <= count_of(t, "(") + 2)
    return base & ((thai_count(t) > 0) | latin)


def weak_thai(text) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    n, thai, latin = F.length(t), thai_count(t), count_of(t, "A-Za-z")
    return (n < 8) | is_stub(t) | (thai < F.greatest(F.lit(4), F.floor(n / 5))) | ((latin > 2 * thai) & (latin > 20))


def usable_thai(text, least: int = 3, density: float = 0.15) -> Column:
    """Enough real Thai, not a single stray letter."""
    return (thai_count(text) >= least) & (thai_density(text) >= density)


def _caps_soup(t: Column) -> Column:
    c = "[BCDFGHJKLMNPQRSTVWXYZ]"
    return t.rlike(rf"(?:{c}{{6,}}){{2,}}|\b{c}{{10,}}\b")


def healthy_latin(text) -> Column:
    """Words of a Latin language or a product's name: vowels and word breaks, or lower case, or a short name in capitals."""
    t = strip_(F.coalesce(_col(text), F.lit("")))
    letters, vowels, upper = count_of(t, "\\p{L}"), count_of(t, "aeiouAEIOU"), count_of(t, "\\p{Lu}")
    spaces = count_of(t, " \\n\\t")
    words = (vowels >= F.greatest(F.lit(1), F.floor(letters / 8))) & ((spaces >= 1) | (letters <= 24)) & ((upper / F.greatest(letters, F.lit(1)) < 0.85) | (spaces >= 2))
    label = (letters <= 40) & t.rlike("[a-z]") & ~_caps_soup(F.upper(t))
    name = letters.between(2, 8) & (vowels >= 1) & (spaces == 0) & (upper == letters)
    return (t != "") & (t.rlike("(?i)^(?:" + "|".join(PRODUCTS) + ")$") | ((letters >= 2) & (words | label | name)))


def thai_hallucination(text) -> Column:
    """Noise that a recogniser makes up for blank cells: runs of marks, known phrases, short Thai among signs."""
    t = strip_(F.coalesce(_col(text), F.lit("")))
    thai, junk = thai_count(t), count_of(t, r"!@#$%\^&*_'=<>")
    signs = (thai >= 4) & (((junk >= 2) & (thai < 20)) | ((junk >= 1) & (thai < 12) & (F.length(t) <= 24)))
    return t.rlike(r"[!_]{2,}|\*{2,}|'{2,}|" + "|".join(BLANK_CELL_PHRASES)) | signs


def plausible_cell(text) -> Column:
    """Whether a table cell's text may be real: Latin words, a number, some Thai, or a short code with a digit."""
    t = strip_(F.coalesce(_col(text), F.lit("")))
    compact = norm_key(t)
    kinds = F.size(F.array_distinct(F.filter(F.split(compact, ""), lambda c: c != "")))
    latin, thai = count_of(t, "A-Za-z"), thai_count(t)
    digits = F.regexp_replace(compact, "[.,]", "").rlike(r"(?U)^\d+$")
    real = healthy_latin(t) | (~((latin > 6) & (latin > thai * 1.5)) & (digits | (thai >= 2) | ((F.length(compact) <= 6) & compact.rlike(r"(?U)\d"))))
    return (t != "") & ~thai_hallucination(t) & ~((F.length(compact) >= 4) & (kinds <= 2)) & real


def garbled_for_thai(text, tokens: tuple[str, ...] = ()) -> Column:
    """Latin gibberish that a recogniser makes of Thai; empty text and real Latin words are not. `tokens`: known gibberish."""
    t = F.coalesce(_col(text), F.lit(""))
    letters, vowels, upper = count_of(t, "\\p{L}"), count_of(t, "aeiouAEIOU"), count_of(t, "\\p{Lu}")
    known = F.exists(F.array(*map(F.lit, tokens)), lambda x: F.upper(norm_key(t)).contains(x)) if tokens else F.lit(False)
    soup = _caps_soup(F.upper(t)) & (vowels <= letters * 0.12) & (count_of(t, " ") <= 1)
    crumbs = (thai_count(t) == 0) & (upper >= letters * 0.75) & (vowels <= F.greatest(F.lit(1), F.floor(letters / 6)))
    residue = (letters >= 8) & (letters < 12) & (thai_count(t) == 0) & (count_of(t, "\\p{Nd}") / F.greatest(F.length(strip_(t)), F.lit(1)) > 0.45)
    latin = ~usable_thai(t) & (known | (~healthy_latin(t) & (letters >= 6) & (soup | crumbs | residue)))
    return (strip_(t) != "") & (t.rlike("|".join(NAME_PHRASES)) | latin)


def footer_noise(text) -> Column:
    return _col(text).rlike("(?U)" + FOOTER_NOISE)


def scrub_footer(text) -> Column:
    """Without the crumbs of forms and footers, white space as single spaces."""
    t = _col(text)
    for crumb in FOOTER_CRUMBS:
        t = F.regexp_replace(t, "(?U)" + crumb, " ")
    return strip_(F.regexp_replace(t, SPACE, " "))


def polish_list(text) -> Column:
    """Text with list markers put right: quotes and wide brackets behind a number, and numbers said twice. Lines of up to
    three Thai characters without a digit go."""
    stray = lambda x: (strip_(x) != "") & (thai_count(x) <= 3) & ~x.rlike(r"(?U)\d")
    t = strip_(F.array_join(F.filter(F.split(_col(text), "\n"), lambda x: ~stray(x)), "\n"))
    t = F.regexp_replace(t, "(?mU)^(\\d{1,2})\\s*[\"\u201c\u201d\u2018\u2019']+", "$1)")
    t = F.replace(F.replace(t, F.lit("11\""), F.lit("11)")), F.lit("11'"), F.lit("11)"))
    t = F.regexp_replace(t, "(?mU)^(\\d{1,2})\\s*\uff09", "$1)")
    t = F.regexp_replace(t, r"(?U)^(\d{1,2}\))\s+\1\s*", "$1 ")
    t = F.regexp_replace(t, r"(?U)^(\d{1,2}\))\s+\d{1,2}\s+", "$1 ")
    return F.when(stray(_col(text)), F.lit("")).otherwise(strip_(F.regexp_replace(t, SPACE, " ")))


def markers_in(text, markers) -> Column:
    """Those of the markers that the text has: as they stand first, then those written with spaces or a comma."""
    t = arabic_digits(F.coalesce(_col(text), F.lit("")))
    loose = F.replace(norm_key(t), F.lit(","), F.lit("."))
    plain = F.filter(_col(markers), lambda m: t.contains(m))
    return F.concat(plain, F.filter(_col(markers), lambda m: ~t.contains(m) & loose.contains(m)))


def render_scale(quality, languages, hurried: bool = False, override: float | None = None) -> Column:
    """Pixels for a point of the page; a scale that is given holds, from 1 to 20."""
    if override is not None:
        return F.lit(max(1.0, min(override, 20.0)))
    q = _col(quality)
    known = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv)), q), F.lit(SCALES["accurate"]))
    return F.when(wants_thai(languages) & (q == "fast"), F.greatest(known, F.lit(THAI_FAST_SCALES[hurried]))).otherwise(known)


def trim_percent(value) -> Column:
    """A margin to cut, in percent: 25 at most."""
    return F.greatest(F.lit(0.0), F.least(_col(value).cast("double"), F.lit(25.0)))


def refuse_latin(text, languages) -> Column:
    """The trimmed text, or nothing where Thai is wanted and the text is gibberish."""
    t = strip_(F.coalesce(_col(text), F.lit("")))
    return F.when(wants_thai(languages) & garbled_for_thai(t), F.lit("")).otherwise(t)


def strip_tags(html, by: str = " ") -> Column:
    return F.regexp_replace(_col(html), "<[^>]+>", by)


def escape_html(text) -> Column:
    t = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def line_html(text) -> Column:
    """A line as a heading by its number signs, as a bold paragraph if it is a header, else as a paragraph."""
    t = strip_(text)
    rest = lambda n: escape_html(strip_(F.substr(t, F.lit(n + 1))))
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    return (
        F.when(t == "", F.lit("")).when(t.startswith("### "), tag("h3", rest(4))).when(t.startswith("## "), tag("h2", rest(3)))
        .when(t.startswith("# "), tag("h1", rest(2))).when(is_header(t), tag("p", tag("b", escape_html(t)))).otherwise(tag("p", escape_html(t)))
    )


def sanitize_filename(name, longest: int = 100) -> Column:
    t = F.regexp_replace(F.coalesce(_col(name), F.lit("")), "[^A-Za-z0-9_.-]", "_")
    t = F.left(F.regexp_replace(F.regexp_replace(t, r"\.\.+", "."), r"^\.+", ""), F.lit(longest))
    return F.when(t == "", F.lit("unnamed")).otherwise(t)


def sanitize_component(value) -> Column:
    return F.regexp_replace(F.coalesce(_col(value), F.lit("")), "[^A-Za-z0-9_-]", "")


def script_runs(text) -> Column:
    """array<string>: runs of Thai and of other characters; a space after Thai stays with it."""
    return F.regexp_extract_all(_col(text), F.lit(f"[{THAI}][{THAI} ]*|[^{THAI}]+"), F.lit(0))


def thai_join(parts) -> Column:
    """Parts joined by a space, but by nothing between two Thai characters."""
    step = lambda acc, p: F.when(acc == "", p).when(acc.rlike(f"[{THAI}]$") & p.rlike(f"^[{THAI}]"), F.concat(acc, p)).otherwise(F.concat(acc, F.lit(" "), p))
    return F.aggregate(F.filter(F.transform(_col(parts), strip_), lambda p: p != ""), F.lit(""), step)


def wants_thai(language) -> Column:
    """Whether a list of language codes has Thai."""
    codes = F.lower(F.coalesce(_col(language), F.lit("")))
    return F.array_contains(F.split(codes, r"[+\s,]+"), "th") | codes.contains("tha")


def route_engine(requested, language) -> Column:
    """A named engine runs alone; else Thai goes to the Thai engine, all other languages to the multilingual one."""
    asked = F.lower(F.coalesce(_col(requested), F.lit("auto")))
    return F.when(asked != "auto", asked).when(wants_thai(language), F.lit("thai")).otherwise("multilingual")


def token_jaccard(a, b) -> Column:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(_col(c)), " +"), lambda w: w != ""))
    both, every = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when(every > 0, both / every).otherwise(0.0)


def compose():
    """A pandas function for canonical composition, which Spark lacks."""
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return nfc
