"""Scalar functions of labels, paths, tokens and scores, as column expressions; byte lengths are meant where tokens are filtered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def label_norm(c: Column) -> Column:
    """Letters and digits only, lower case; null if nothing is left."""
    n = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(n != "", n)


def label_tokens(c: Column) -> Column:
    """Words of an identifier: split at other characters and between lower and upper case, longer than a byte."""
    split = F.split(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+")
    return F.filter(F.transform(split, F.lower), lambda t: F.octet_length(t) > 1)


def words(c: Column, longer_than: int, extra: str = "") -> Column:
    """Lower-case runs of letters and digits (and ``extra``) of more bytes than given; repeated words stay."""
    return F.filter(F.split(F.lower(c), rf"[^\p{{L}}\p{{N}}{extra}]+"), lambda t: F.octet_length(t) > longer_than)


def overlap(a: Column, b: Column) -> Column:
    """Words of ``a`` that are in ``b``, repeated ones counted, by the longer list's length; 0 if one is empty."""
    common = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r".\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def is_file_node(label: Column, path: Column) -> Column:
    """A file's own node, or a method stub like ``.name()``."""
    label = F.coalesce(label, F.lit(""))
    return ((file_stem(path) != "") & (label == file_stem(path))) | (label.startswith(".") & label.endswith("()"))


def is_concept_node(path: Column) -> Column:
    """A node without a file: no path, or one without extension and folder."""
    return (path == "") | (~base_name(path).contains(".") & ~path.contains("/") & ~path.contains("\\"))


def logical_key(path: Column, label: Column) -> Column:
    """Last two parts of the path, ``::``, label without ``()``."""
    return F.concat(F.substring_index(path, "/", -2), F.lit("::"), F.regexp_replace(label, r"\(\)$", ""))


def line_number(location: Column) -> Column:
    """L348, 348, L1-L5 -> first number."""
    return F.regexp_extract(location, r"^L*(\d+)", 1).try_cast("int")


def short_hash(c: Column) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(16))


def fingerprint(file_type: Column, path: Column, location: Column, body: Column) -> Column:
    """Hash of kind, file name, location and body without white space; the label is left out, so renames keep it."""
    text = F.concat_ws("|", file_type, base_name(path), F.coalesce(location, F.lit("")), F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", ""))
    return short_hash(text)


def recency_points(now: int, at: Column) -> Column:
    age = F.floor((F.lit(now) - at) / 86_400)
    points = F.when(age < 7, 10.0).when(age < 30, 5.0).when(age < 90, 0.0).when(age < 180, -5.0).otherwise(-10.0)
    return F.when((at > 0) & (at <= now), points).otherwise(0.0)


def reinforced(confidence: Column, times: Column | int = 1) -> Column:
    """Confidence after being observed again."""
    return 1 - (1 - confidence) * F.pow(F.lit(0.8), F.lit(times) if isinstance(times, int) else times)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Kinds of files by extension.
FILE_KINDS = {
    "code": ("py", "ts", "js", "jsx", "tsx", "mjs", "ejs", "go", "rs", "java", "cpp", "cc", "cxx", "c", "h", "hpp", "rb", "swift", "kt", "kts", "cs", "scala", "php", "lua", "toc", "zig", "ps1", "ex", "exs", "m", "mm", "jl", "vue", "svelte", "dart", "v", "sv",),
    "document": ("md", "mdx", "txt", "rst", "html", "yaml", "yml",),
    "paper": ("pdf",),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "svg",),
    "video": ("mp4", "mov", "webm", "mkv", "avi", "m4v", "mp3", "wav", "m4a", "ogg",),
    "office": ("docx", "xlsx",),
}


def file_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, names in FILE_KINDS.items():
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out


#: Languages by extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala", "kt": "kotlin", "lua": "lua", "sh": "bash", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "md": "markdown", "xml": "xml", "sql": "sql"}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ext)


#: Patterns of paths that are never read.
SENSITIVE = (r"(^|[\\/])\.(env|envrc)(\.|$)", r"\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(credential|secret|passwd|password|token|private_key)", r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$", r"(\.netrc|\.pgpass|\.htpasswd)$", r"(aws_credentials|gcloud_credentials|service.account)")


def is_sensitive(path: Column) -> Column:
    out = F.lit(False)
    for p in SENSITIVE:
        out = out | path.rlike(f"(?i){p}")
    return out


def word_count(text: Column) -> Column:
    """Words split by white space."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


#: Signs of a paper, of which PAPER_LEAST are needed.
PAPER_SIGNS = (r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b")
PAPER_LEAST = 3


def paper_signs(text: Column) -> Column:
    out = F.lit(0)
    for p in PAPER_SIGNS:
        out = out + text.rlike(p).cast("int")
    return out


def commit_kind(message: Column) -> Column:
    """Kind of knowledge a commit message stands for; null for noise, short and generic ones."""
    m = F.lower(message)
    has = m.rlike
    noise = m.rlike("^(merge|wip|chore)") | (F.octet_length(m) < 15)
    return (
        F.when(noise, None).when(has("fix|bug|crash"), "bug_pattern").when(has("refactor|cleanup|simplif"), "decision").when(has("add") & has("feature|support"), "architecture")
        .when(has("critical|breaking|important"), "lesson").when(has("convention|style|format"), "convention").when(has("perf|optim|speed"), "performance")
    )


def url_kind(url: Column) -> Column:
    u = F.lower(url)
    return (
        F.when(u.rlike(r"twitter\.com|x\.com"), "tweet").when(u.contains("arxiv.org"), "arxiv").when(u.contains("github.com"), "github").when(u.rlike(r"youtube\.com|youtu\.be"), "youtube")
        .when(u.endswith(".pdf"), "pdf").when(u.rlike(r"\.(png|jpg|jpeg|gif|webp)$"), "image").otherwise("webpage")
    )


def safe_label(c: Column) -> Column:
    """Without control characters, at most 256 characters."""
    return F.left(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), F.lit(256))


def xml_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_symbols(c: Column) -> Column:
    """Without characters beyond ASCII that are neither letters nor digits; letters keep their accents."""
    return F.regexp_replace(c, r"[^\x00-\x7F\p{L}\p{N}]", "")


def js_escaped(c: Column) -> Column:
    """For a string literal in a script of a page."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("</", "<\\/")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mermaid_escaped(c: Column) -> Column:
    """For a quoted label of a chart."""
    return F.regexp_replace(F.replace(c, F.lit('"'), F.lit("#quot;")), r"[\n\r\[\]{}|<>]", " ")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', "_")


def body_form(source: Column) -> Column:
    """A body without comments and white space, so that edits of form do not count; strings are not told apart."""
    bare = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"(?m)(//|#).*$", "")
    return F.regexp_replace(bare, r"\s+", "")


def body_hash(source: Column) -> Column:
    return short_hash(body_form(source))


def highlighted(label: Column, query: str) -> Column:
    """The label with the letters in brackets that a fuzzy match of the query's words takes, neighbours together."""
    from loamgraph.operators.search import marked

    @F.pandas_udf("string")
    def mark(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: None if x is None else marked(x, query))

    return mark(label)


def civil_date(at: Column) -> Column:
    """yyyy-MM-dd (UTC) of epoch seconds."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86_400).cast("int")), "yyyy-MM-dd")
