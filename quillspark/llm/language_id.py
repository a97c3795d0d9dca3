"""Language identification of web pages by Bayesian evidence fusion (operator 7).

Evidence of a page: the likelihood of its text under hashed letter trigrams, which are counted over
all documents with a known language; the language that its markup declares; the language code in
its address; and its host. How far declarations can be trusted is counted too: grouped over all
pages, how often a code is declared where the text speaks for a language. The host's prior is the
sum of its other pages' beliefs, smoothed by the prior of its domain, that by the prior of its
address suffix, and that by the prior of all pages; each level is a grouped aggregation of the level
below, and the page's own belief is taken out of the host's sum.

Null html or url is no evidence; a page without any gets its host's prior. Ties go to the language
named first. The table of trigrams has ``len(languages) * BUCKETS`` entries and the declared codes
``len(languages) + 1`` values, whatever the data; priors of hosts are joined, not broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, stored

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 13
#: Trigrams of a text are far from independent: their sum of logarithms counts for this share.
TEXT_WEIGHT = 0.25
#: Pages that a level's prior weighs as much as, in the level below it.
HOST_WEIGHT, DOMAIN_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0, 50.0
#: Imagined pages for each (declared code, language): these for agreement and for each of the others.
TRUST, DISTRUST = 8.0, 0.5
NONE = "none"
#: Labels below a country's suffix under which names are given out.
_SECOND = r"(?:co|com|org|net|ac|gov|edu)\.[a-z]{2}"
_CODE = re.compile(r"\s*([a-zA-Z]{2,3})")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/"']+)\s*(=)?\s*""")
_NAMING = re.compile(r"(?i)<(html|meta)(?=[\s/>])")
_RAW = re.compile(r"(?i)<(script|style)\b")
_HIDDEN = re.compile(r"(?i)<(script|style|head|nav)\b")
_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "head", "nav")}


def visible(html: str) -> str:
    """The text of a page without tags, comments, and what lies in elements that are not shown.

    One pass: an end that was not found once is not looked for again, so that unclosed marks cost no more.
    """
    parts, at, missing = [], 0, set()

    def end_of(name: str, place: int):
        if name in missing:
            return None
        if name in _ENDS:
            found = _ENDS[name].search(html, place)
            end = found.end() if found else -1
        else:
            end = html.find(name, place)
            end = end + len(name) if end >= 0 else -1
        if end < 0:
            missing.add(name)
        return end if end >= 0 else None

    while (start := html.find("<", at)) >= 0:
        parts.append(html[at:start])
        hidden = _HIDDEN.match(html, start)
        end = end_of("-->", start + 4) if html.startswith("<!--", start) else end_of(hidden[1].lower(), start) if hidden else None
        end = end or end_of(">", start)
        if end is None:
            at = start
            break
        at = end
    return " ".join([*parts, html[at:]])


def declared_language(html: str) -> str:
    """The code that a page's ``<html lang>``, or else its content-language ``<meta>``, begins with, in lower case; "" if none does.

    One pass over the tags: comments, scripts and styles are passed over, quoted values may hold ``>``, and
    an end that was not found once is not looked for again.
    """
    at, missing, said = 0, set(), ""

    def past(mark: str, place: int) -> int:
        end = -1 if mark in missing else html.find(mark, place)
        if end < 0:
            missing.add(mark)
        return end + len(mark) if end >= 0 else -1

    def attributes(place: int):
        """(name, value) pairs up to the tag's end, then (None, where it ends)."""
        while place < len(html) and html[place] != ">":
            found = _ATTRIBUTE.match(html, place)
            if not found:  # a stray quote, slash or equals sign
                place += 1
                continue
            place, value = found.end(), ""
            if found[2]:
                quote = html[place : place + 1]
                end = past(quote, place + 1) if quote in ("'", '"') and quote else -1
                if end >= 0:
                    value, place = html[place + 1 : end - 1], end
                else:
                    start = place
                    while place < len(html) and html[place] not in "> \t\r\n\f":
                        place += 1
                    value = html[start:place].strip("'\"")
            yield found[1].lower(), value
        yield None, place + 1

    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            at = past("-->", start + 4)
            if at < 0:
                return said
            continue
        raw = _RAW.match(html, start)
        if raw:
            name = raw[1].lower()
            end = None if name in missing else _ENDS[name].search(html, at)
            if end:
                at = end.end()
            else:
                missing.add(name)
            continue
        if not html[at : at + 1].isalpha():
            continue
        tag, held = _NAMING.match(html, start), {}
        begin = tag.end() if tag else at
        for name, value in attributes(begin):
            if name is None:
                at = value
            else:
                held.setdefault(name, value)
        if tag and tag[1].lower() == "html":
            code = _CODE.match(held.get("lang") or held.get("xml:lang") or "")
            if code:
                return code[1].lower()
        elif tag and not said and "content-language" in (held.get("http-equiv", "").strip().lower(), held.get("name", "").strip().lower()):
            code = _CODE.match(held.get("content", ""))
            said = code[1].lower() if code else ""
    return said


def _trigrams(text: str):
    """Buckets of the trigrams of a text, lower-cased, with everything but letters read as spaces."""
    import numpy as np

    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xAA)
    c = np.where(letter, codes, np.uint32(32))
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    word = letter[:-2] | letter[1:-1] | letter[2:]
    mixed = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed[word] >> np.uint32(19)).astype(np.int64)


def trigram_counts(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(lang, bucket, n) over all of ``docs`` (text, lang); other languages, nulls, are left out."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                total[languages.index(lang)] += np.bincount(_trigrams(text.as_py()), minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch(
            [pa.array([languages[i] for i in lang], pa.string()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket])],
            names=["lang", "bucket", "n"],
        )

    known = docs.select("text", "lang").where(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    return known.mapInArrow(rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES):
    """Logarithms of the smoothed trigram shares, one row for each language."""
    import numpy as np

    got = trigram_counts(docs, languages).toArrow()  # at most len(languages) * BUCKETS rows
    counts = np.full((len(languages), BUCKETS), 0.5)
    at = [languages.index(x) for x in got.column("lang").to_pylist()]
    counts[at, got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def page_evidence(pages: DataFrame, model, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(page_id, host, domain, suffix, declared, in_address, text_log): each page's own evidence."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = dict(pages.dtypes)["page_id"]

    def rows(batches):
        import html

        import numpy as np
        import pyarrow as pa

        logs = shared.value
        for batch in batches:
            found, said = [], []
            for value in batch.column("html"):
                page = value.as_py() or ""
                said.append(declared_language(page))
                found.append(np.bincount(_trigrams(html.unescape(visible(page))), minlength=BUCKETS) @ logs.T)
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(said, pa.string()), pa.array(found, pa.list_(pa.float64()))],
                names=["page_id", "url", "declared", "text_log"],
            )

    d = pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kind}, url string, declared string, text_log array<double>")
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    code = F.lower(F.regexp_extract(url, r"^[^?#]*?//[^/?#]*/([A-Za-z]{2})(?:[/?#_-]|$)", 1))
    known = lambda c: F.when(c.isin(*languages), c).otherwise(F.lit(NONE))
    return d.select(
        "page_id",
        host.alias("host"),
        F.regexp_extract(host, rf"([^.]+\.(?:{_SECOND}|[^.]+))$", 1).alias("domain"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        known(F.col("declared")).alias("declared"),
        known(code).alias("in_address"),
        "text_log",
    )


def _belief(log: Column) -> Column:
    """Probabilities from an array of logarithms."""
    powers = F.transform(log, lambda x: F.exp(x - F.array_max(log)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _trust(d: DataFrame, column: str, belief: Column, languages: tuple[str, ...]) -> Column:
    """Log-likelihoods of a declared code for each language, counted over all pages; no code says nothing."""
    sums = [F.sum(F.get(belief, i)).alias(f"s{i}") for i in range(len(languages))]
    got = {r[column]: r for r in d.groupBy(column).agg(*sums).collect()}  # at most len(languages) + 1 rows
    held = {
        c: [(got[c][f"s{i}"] if c in got else 0.0) + (TRUST if c == lang else DISTRUST) for i, lang in enumerate(languages)] for c in languages
    }
    totals = [sum(held[c][i] for c in languages) for i in range(len(languages))]
    out = F.array(*[F.lit(0.0)] * len(languages))
    for c in languages:
        out = F.when(F.col(column) == c, F.array(*[F.log(F.lit(held[c][i] / totals[i])) for i in range(len(languages))])).otherwise(out)
    return out


def host_priors(d: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> tuple[DataFrame, Column]:
    """((host, n, sums, above), prior of all pages): a host's pages and beliefs, and the smoothed prior of the levels above it.

    ``d``: host, domain, suffix and belief of each page. Pages without a host count for the prior of all alone.
    """
    size = range(len(languages))
    total = lambda c: F.array(*[F.sum(F.get(c, i)) for i in size])
    mixed = lambda sums, n, weight, above: F.transform(
        _add(sums, F.transform(above, lambda p: p * weight)), lambda x: x / (n + weight)
    )
    hosts = stored(
        d.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), total(F.col("belief")).alias("sums")), "hosts"
    )
    named = hosts.where("host <> ''")
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), total(F.col("sums")).alias("ds"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), total(F.col("ds")).alias("ss"))
    everything = hosts.agg(F.sum("n").alias("n"), total(F.col("sums")).alias("s")).first()
    n = everything["n"] or 0
    base = F.array(*[F.lit(((everything["s"][i] or 0.0) + 1.0) / (n + len(languages))) for i in size])
    suffixes = suffixes.select("suffix", mixed(F.col("ss"), F.col("sn"), SUFFIX_WEIGHT, base).alias("sp"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", mixed(F.col("ds"), F.col("dn"), DOMAIN_WEIGHT, F.col("sp")).alias("above"))
    return stored(named.join(domains, ["domain", "suffix"]).select("host", "n", "sums", "above"), "priors"), base


def identify(pages: DataFrame, docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(page_id, host, declared, lang, confidence, text_lang, beliefs) of each of ``pages`` (page_id, url, html).

    Repeated rows are pages of their own; other columns are ignored; an empty table gives no row. A
    page's own belief is taken out of its host's sum, and stays in those of domain and suffix.
    """
    own = stored(page_evidence(pages, text_model(docs, languages), languages), "evidence")
    text = F.transform("text_log", lambda x: x * TEXT_WEIGHT)
    text_belief = _belief(text)
    markup = _add(_trust(own, "declared", text_belief, languages), _trust(own, "in_address", text_belief, languages))
    log = own.select("*", _add(text, markup).alias("log"))
    believed = stored(log.select("page_id", "host", "domain", "suffix", "declared", "text_log", "log", _belief(F.col("log")).alias("belief")), "beliefs")
    # both sides are stored tables, so the pages of a very large host can be split
    priors, base = host_priors(believed, languages)
    # a page without a host shares none with others: the prior of all pages is its own
    d = believed.join(priors, "host", "left")
    others = F.transform(F.zip_with("sums", "belief", lambda s, b: F.greatest(s - b, F.lit(0.0))), lambda x: x)
    prior = F.transform(_add(others, F.transform("above", lambda p: p * HOST_WEIGHT)), lambda x: x / (F.col("n") - 1 + HOST_WEIGHT))
    prior = F.coalesce(prior, base)
    d = d.withColumn("beliefs", _belief(F.zip_with("log", prior, lambda e, p: e + F.log(p))))
    first = lambda c: F.get(F.array(*map(F.lit, languages)), F.array_position(c, F.array_max(c)).cast("int") - 1)
    return d.select(
        "page_id",
        "host",
        "declared",
        first(F.col("beliefs")).alias("lang"),
        F.array_max("beliefs").alias("confidence"),
        first(F.col("text_log")).alias("text_lang"),
        "beliefs",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; trigrams are counted over all ``documents``."""
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents")).drop("beliefs")
