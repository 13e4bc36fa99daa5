"""Scalar text functions as JVM expressions: names, licences, rates, figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.names import strip

#: Spellings of licences and the canonical name of each.
LICENCES = {
    "cc0": "CC0-1.0", "cc0-1.0": "CC0-1.0", "cc0 1.0": "CC0-1.0", "cc by 4.0": "CC-BY-4.0", "cc-by-4.0": "CC-BY-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc by sa 4.0": "CC-BY-SA-4.0", "public domain": "Public domain", "pd": "Public domain",
}
#: Parts of a licence's name that plain attribution doesn't cover, and how names begin that oblige to nothing.
UNCOVERED_PARTS = ("-sa", "share", "nc", "noncommercial", "non-commercial", "nd", "noderiv", "no-deriv", "gfdl")
FREE_STARTS = ("cc0", "public-domain", "no-rights", "copyrighted-free-use")
#: Bands of film speed by their lower bound.
ISO_BANDS = {"base": 0, "low": 200, "high": 800, "extreme": 3200}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(name: Column | str) -> Column:
    """The name before its last dot; a leading dot begins no extension."""
    return F.regexp_replace(_c(name), r"(?<=.)\.[^.]*$", "")


def extension(name: Column | str) -> Column:
    """The part behind the last dot, lower case; null without one or for a leading dot only."""
    got = F.lower(F.regexp_extract(_c(name), r"(?<=.)\.([^.]*)$", 1))
    return F.when(got != "", got)


def image_format(name: Column | str) -> Column:
    """Format by extension: ``jpg`` is ``jpeg``, ``tif`` is ``tiff``."""
    ext = extension(name)
    return F.when(ext == "jpg", "jpeg").when(ext == "tif", "tiff").otherwise(ext)


def is_plain_file_name(name: Column | str) -> Column:
    """Whether the name has no separators or control characters and is not empty, ``.`` or ``..``."""
    n = _c(name)
    return n.rlike(r"^[^/\\\x00-\x1f\x7f]+$") & ~n.isin(".", "..")


def canonical_licence(licence: Column | str) -> Column:
    """The canonical name of a known spelling, else the trimmed spelling; null stays null."""
    low = F.regexp_replace(F.translate(F.lower(strip(licence)), "_", " "), r"\s+", " ")
    table = F.create_map(*[F.lit(x) for pair in LICENCES.items() for x in pair])
    return F.coalesce(table[low], strip(licence))


def obligation(licence: Column | str) -> Column:
    """``none`` for dedications, ``attribution`` for plain attribution licences, else ``uncovered`` (share-alike, no
    derivatives, non-commercial, unknown); null is uncovered. Blanks count as hyphens, so any version's spelling is known."""
    low = F.replace(F.lower(canonical_licence(licence)), F.lit(" "), F.lit("-"))
    free = None
    for start in FREE_STARTS:
        free = low.startswith(start) if free is None else free | low.startswith(start)
    return F.when(low.rlike("|".join(UNCOVERED_PARTS)), "uncovered").when(free, "none").when(low.startswith("cc-by"), "attribution").otherwise("uncovered")


def arm_key(tool: Column | str, rate: Column | str) -> Column:
    """``tool-0400``: the rate in thousandths, rounded half to even."""
    return F.format_string("%s-%04d", _c(tool), F.bround(_c(rate) * 1000).cast("long"))


def arm_text(embedder: Column, rate: Column, unit: Column) -> Column:
    """``X at 0.400 bpp``, ``X at 20.000% of capacity`` or the embedder alone."""
    return (
        F.when(rate.isNull() | unit.isNull(), embedder).when(unit == "bpp", F.format_string("%s at %.3f bpp", embedder, rate)).otherwise(F.format_string("%s at %.3f%% of capacity", embedder, rate * 100))
    )


def iso_band(value: Column | str) -> Column:
    """Band of a film speed; null where it isn't a positive number."""
    n = F.regexp_extract(_c(value).cast("string"), r"^\s*(\d{1,9})\b", 1)
    n = F.when(n != "", n.cast("long"))
    out = None
    for name, low in sorted(ISO_BANDS.items(), key=lambda x: -x[1]):
        out = F.when(n >= low, name) if out is None else out.when(n >= low, name)
    return out


def undouble(text: Column | str) -> Column:
    """A text that repeats itself exactly, with a space, a semicolon and space, or nothing between, once; at least 4 characters."""
    t = _c(text)
    return F.regexp_replace(t, r"(?s)^(.{4,}?)(?: |; |)\1$", "$1")


def strip_html(html: Column | str) -> Column:
    """Text of a fragment: comments, scripts and tags removed, the common character references resolved, blanks collapsed."""
    t = F.regexp_replace(_c(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def urls(text: Column | str) -> Column:
    """URLs of a text in order, without closing punctuation."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def host(url: Column | str) -> Column:
    """Host of a URL, lower case."""
    got = F.lower(F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return F.when(got != "", got)


def attribution(title: Column, author: Column, source: Column, licence: Column, modification: str = "cropped") -> Column:
    """One credit line of the parts that are known."""
    return F.concat_ws(" ", title, F.concat(F.lit("by "), author), F.concat(F.lit("("), source, F.lit(")")), F.concat(F.lit("licensed "), licence), F.lit(f"[{modification}]"))


def percent(rate: Column) -> Column:
    """A rate as percent with at most four decimals and no trailing zeros."""
    return F.concat(F.regexp_replace(F.format_string("%.4f", rate * 100), r"\.?0+$", ""), F.lit("%"))


def abbreviated(digest: Column | str, n: int = 12) -> Column:
    d = _c(digest)
    return F.when(F.length(d) > n, F.concat(F.left(d, F.lit(n)), F.lit("…"))).otherwise(d)


def csv_field(value: Column | str) -> Column:
    """Quoted where it holds a comma, quote or line break, quotes doubled."""
    v = _c(value)
    return F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def markdown_cell(value: Column | str) -> Column:
    return F.replace(F.replace(_c(value), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def human_bytes(n: Column | str) -> Column:
    """Bytes in binary units with one decimal."""
    n = _c(n).cast("double")
    out = F.when(n < 1024, F.format_string("%.0f B", n))
    for i, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", n / 1024.0**i))
    return out.otherwise(F.format_string("%.1f TiB", n / 1024.0**4))


def payload_seed(corpus_seed: int, image: Column | str, tool: Column | str, rate: Column | str, scheme: str = "payload-v1") -> Column:
    """SHA-256 over the parts of a payload's identity, parted by unit separators."""
    return F.sha2(F.concat_ws("\x1f", F.lit(scheme), F.lit(str(corpus_seed)), _c(image), _c(tool), F.format_string("%.6f", _c(rate))), 256)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit prints."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def band(print_: Column | str, index: int, bits: int = 8) -> Column:
    """Bits ``index * bits`` onwards of a print, unsigned."""
    return F.shiftrightunsigned(_c(print_), index * bits).bitwiseAND((1 << bits) - 1)


def zsteg_reading(stdout: Column | str) -> Column:
    """Verdict of a line report: true if any line holds a hit (``label .. text: ...``), null for no output at all."""
    s = _c(stdout)
    return F.when(F.trim(s) == "", None).otherwise(s.rlike(r"(?m)^\S.*\.\. (?:text|file|zlib|wbStego|openstego)"))


def last_csv_number(stdout: Column | str) -> Column:
    """The last numeric field of the last line that has one."""
    lines = F.reverse(F.split(_c(stdout), "\n"))
    numbers = F.transform(lines, lambda ln: F.try_element_at(F.filter(F.reverse(F.transform(F.split(ln, ","), lambda f: F.trim(f))), lambda f: f.rlike(NUMBER)), F.lit(1)))
    return F.try_element_at(F.filter(numbers, lambda x: x.isNotNull()), F.lit(1)).cast("double")


#: Fixed value: how a finite decimal number is written.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def only_number(stdout: Column | str) -> Column:
    """The number, if the output holds exactly one finite one; else null."""
    tokens = F.filter(F.split(F.trim(_c(stdout)), r"\s+"), lambda t: t.rlike(NUMBER))
    return F.when(F.size(tokens) == 1, F.try_element_at(tokens, F.lit(1)).cast("double"))


def json_score(stdout: Column | str, field: str = "overall_score") -> Column:
    return F.get_json_object(_c(stdout), f"$.{field}").try_cast("double")


def version_token(text: Column | str) -> Column:
    """The first token that looks like a version number."""
    got = F.regexp_extract(_c(text), r"(?<![\w.])v?(\d+(?:\.\d+)+(?:[-+][0-9A-Za-z.]+)?)(?![\w])", 1)
    return F.when(got != "", got)


def cover_of_path(path: Column | str) -> Column:
    """The cover a file came from, by its name, at whatever depth it lies."""
    return F.regexp_extract(_c(path), r"[^/]*$", 0)


def arm_of_path(path: Column | str) -> Column:
    """The folders a file lies in, joined, as its arm; a file in none is clean."""
    folders = F.regexp_replace(_c(path), r"/?[^/]*$", "")
    return F.when(folders == "", "clean").otherwise(folders)
