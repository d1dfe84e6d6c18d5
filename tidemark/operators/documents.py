"""Facts out of document pages, and checks of nested research documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(text: Column) -> Column:
    """H1: white space collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compact_for_search(text: Column) -> Column:
    """H1: also without breaks between two Han characters."""
    return F.regexp_replace(compact(text), r"(?<=[一-鿿])\s+(?=[一-鿿])", "")


#: H2: fixed values: characters of an excerpt before and behind the place it is of, and at most.
BEFORE, BEHIND, MOST = 100, 520, 800


def excerpt(text: Column, at: Column, width: int = BEHIND) -> Column:
    """H2: the text from BEFORE characters before at (from 0) to width after it, compact, MOST characters at most."""
    start = F.greatest(at - BEFORE, F.lit(0))
    return F.left(compact(F.substring(text, start + 1, at + width - start)), F.lit(MOST))


#: H2, H3: fixed values: what a document is called that can't be read, and whether a flag was found.
UNREADABLE = "UNREADABLE"
FLAG_STATUS = ("FLAG_FOUND", "NOT_FOUND_IN_EXTRACTED_TEXT")


def classify_pages(pages: DataFrame, classes: Sequence[tuple[str, Sequence[str]]], *, doc: str = "doc_id", page: str = "page_no", text: str = "text", negations: Mapping[str, str] | None = None, fallback: tuple[str, Sequence[str], str] | None = None, missing: str = "NOT_FOUND", gate: DataFrame | None = None) -> DataFrame:
    """H2: of each document the class of its first phrase by (priority, page): classification, page, excerpt and its SHA-256.

    A phrase whose class has a negation doesn't count after that character. fallback (class,
    markers, anchor) applies where no phrase is found and all markers stand on one page. With gate, readable()'s
    result, documents that are not readable are UNREADABLE without page and excerpt. The phrases are columns of one pass over
    the pages, not a join.
    """
    negations, t = negations or {}, compact_for_search(F.col(text))
    p = pages.select(doc, page, t.alias("__t"), compact(F.col(text)).alias("__c"))
    hits = []
    for rank, (name, phrases) in enumerate(classes):
        for phrase in phrases:
            at = F.instr("__t", phrase)
            ok = at > 0
            if name in negations:
                ok = ok & ~((at > 1) & (F.substring("__t", at - 1, F.lit(1)) == negations[name]))
            hits.append(F.when(ok, F.struct(F.lit(rank).alias("rank"), F.col(page).alias("page"), F.lit(name).alias("name"), excerpt(F.col("__t"), at - 1).alias("text"))))
    if fallback:
        name, markers, anchor = fallback
        every = reduce(lambda a, b: a & b, [F.col("__c").contains(m) for m in markers])
        hits.append(F.when(every, F.struct(F.lit(len(classes)).alias("rank"), F.col(page).alias("page"), F.lit(name).alias("name"), excerpt(F.col("__c"), F.instr("__c", anchor) - 1).alias("text"))))
    best = p.groupBy(doc).agg(F.min(F.array_min(F.array_compact(F.array(*hits)))).alias("b"))
    if gate is not None:
        best = best.join(gate.select(doc, "readable"), doc, "left").withColumn("b", F.when(F.col("readable"), F.col("b")))
    found = F.col("b").isNotNull()
    none = F.lit(missing) if gate is None else F.when(F.col("readable"), missing).otherwise(UNREADABLE)
    return best.select(doc, F.coalesce("b.name", none).alias("classification"), F.col("b.page").alias("page"), F.col("b.text").alias("excerpt"), F.when(found, F.sha2("b.text", 256)).alias("sha256"))


def flag_phrases(pages: DataFrame, phrases: Sequence[str], *, doc: str = "doc_id", page: str = "page_no", text: str = "text", most: int = 5, gate: DataFrame | None = None) -> DataFrame:
    """H3: of each document its first pages with a phrase (at most most), in page order, and their excerpts; status as FLAG_STATUS.

    With gate, readable()'s result, documents that are not readable are UNREADABLE and have no pages.
    """
    c = compact(F.col(text))
    at = F.coalesce(*[F.when(F.instr("__c", p) > 0, F.instr("__c", p)) for p in phrases])
    hit = pages.select(doc, page, c.alias("__c")).withColumn("__at", at)
    first = hit.where("__at IS NOT NULL").withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("__r") <= most)
    got = first.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, excerpt(F.col("__c"), F.col("__at") - 1).alias("text")))).alias("__h"))
    out = pages.select(doc).distinct().join(got, doc, "left")
    readable_doc = F.lit(True)
    if gate is not None:
        out = out.join(gate.select(doc, "readable"), doc, "left").withColumn("__h", F.when(F.col("readable"), F.col("__h")))
        readable_doc = F.coalesce("readable", F.lit(False))
    return out.select(doc, F.when(~readable_doc, UNREADABLE).when(F.col("__h").isNull(), FLAG_STATUS[1]).otherwise(FLAG_STATUS[0]).alias("status"), F.coalesce(F.col(f"__h.{page}"), F.array().cast("array<bigint>")).alias("pages"), F.coalesce("__h.text", F.array().cast("array<string>")).alias("excerpts"))


#: H4, H5: fixed values: a number with optional sign, brackets, thousands and percent; a note of units.
UNIT_NOTE = r"(?:金额|货币)?单位[：:]\s*([^，。；;]{1,40})"
VALUE = r"(?<![0-9])([(（]?[-+]?[0-9][0-9,]*(?:\.[0-9]+)?[%％]?[)）]?)(?![0-9])"


def unit_before(text: Column, at: Column, pattern: str = UNIT_NOTE, reach: int = 1200) -> Column:
    """H5: the last unit note in the reach characters before at (from 0), null without one."""
    start = F.greatest(at - reach, F.lit(0))
    found = F.regexp_extract_all(compact(F.substring(text, start + 1, at - start)), F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def labelled_values(pages: DataFrame, metrics: Mapping[str, Sequence[str]], *, amounts: Sequence[str] = (), doc: str = "doc_id", page: str = "page_no", text: str = "text", most_pages: int = 80, reach: int = 180, unit: str | None = None) -> DataFrame:
    """H4: of each document and metric the value after its label on the first page that has one: metric, raw_value, unit, page.

    A value stands within reach characters of the label; a percentage is no value of an amount, and
    the next label or page is tried. Only the first most_pages pages of a document are statements.
    """
    p = pages.where(F.col(page) <= most_pages).select(doc, page, compact_for_search(F.col(text)).alias("__t"))
    rows = []
    for metric, labels in metrics.items():
        tries = []
        for label in labels:
            at = F.instr("__t", label)
            raw = F.regexp_extract(F.substring(F.col("__t"), at + len(label), F.lit(reach)), VALUE, 1)
            ok = (at > 0) & (raw != "")
            if metric in amounts:
                ok = ok & ~raw.rlike("[%％]$")
            note = unit_before(F.col("__t"), at - 1, *([unit] if unit else []))
            tries.append(F.when(ok, F.struct(F.lit(metric).alias("metric"), raw.alias("raw_value"), note.alias("unit"))))
        rows.append(F.coalesce(*tries))
    long = p.select(doc, page, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(doc, page, "x.*")
    return long.groupBy(doc, "metric").agg(F.min_by("raw_value", page).alias("raw_value"), F.min_by("unit", page).alias("unit"), F.min(page).alias("page"))


def report_year(pages: DataFrame, *, doc: str = "doc_id", page: str = "page_no", text: str = "text", title: str = "title", pattern: str = r"(20[0-9]{2})\s*年(?:度|年度)?报告", first_pages: int = 5) -> DataFrame:
    """H6: of each document the year in its title, else on its first pages; null without one."""

    def year(c: str) -> Column:
        return F.regexp_extract(c, pattern, 1).try_cast("int")

    by_page = pages.groupBy(doc).agg(F.max(year(title)).alias("__title"), F.min_by(year(text), F.when((F.col(page) <= first_pages) & year(text).isNotNull(), F.col(page))).alias("__page"))
    return by_page.select(doc, F.coalesce("__title", "__page").alias("report_year"))


def readable(pages: DataFrame, *, doc: str = "doc_id", text: str = "text", least: int = 1000, per_page: int = 20) -> DataFrame:
    """H6: of each document its pages, characters and whether it has text enough to read."""
    sums = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("chars"))
    return sums.withColumn("readable", F.col("chars") >= F.greatest(F.lit(least), per_page * F.col("pages")))


def html_rows(pages: DataFrame, *, page_id: str, html: str, row: str = r"(?is)<tr[^>]*>(.*?)</tr>", cell: str = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>") -> DataFrame:
    """H7: page_id, row_no, cells: the text of each table cell, tags removed, by row."""
    rows = pages.select(page_id, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(1))).alias("row_no", "__r"))
    cells = F.regexp_extract_all("__r", F.lit(cell), F.lit(1))
    return rows.select(page_id, "row_no", F.transform(cells, lambda c: compact(F.regexp_replace(c, r"<[^>]*>", ""))).alias("cells"))


def fill_down(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """H7: empty cells take the last value above them (row spans)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(w) for c in columns})


def html_blocks(pages: DataFrame, *, page_id: str, html: str, tag: str) -> DataFrame:
    """H7: page_id, block_no, text of each element of a tag, tags inside removed."""
    blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return pages.select(page_id, F.posexplode(blocks).alias("block_no", "__b")).select(page_id, "block_no", compact(F.regexp_replace("__b", r"<[^>]*>", " ")).alias("text"))


def field_between(text: Column, label: str, labels: Sequence[str]) -> Column:
    """H8: what stands between a label and the next of labels (or the end); tried again without white space; null without it."""
    rest = "|".join(x for x in labels if x != label)

    def once(t: Column, names: str, own: str) -> Column:
        got = F.trim(F.regexp_extract(t, rf"(?s){own}[：:\s]*(.*?)(?:{names}|$)", 1))
        return F.when(got != "", got)

    return F.coalesce(once(text, rest, label), once(F.regexp_replace(text, r"\s+", ""), rest.replace(" ", ""), label.replace(" ", "")))


def links(pages: DataFrame, *, page_id: str, html: str, suffix: str = "") -> DataFrame:
    """H9: distinct links of a page (to names with suffix)."""
    found = F.regexp_extract_all(html, F.lit(rf"""(?i)href\s*=\s*["']([^"'#]*{suffix})["']"""), F.lit(1))
    return pages.select(page_id, F.explode(found).alias("link")).distinct()


def integrity(cards: DataFrame, *, card_id: str = "card_id", now: str) -> DataFrame:
    """For each card: unknown references, duplicate evidence ids, evidence after the card, a card from the future, ok.

    cards: card_id, as_of, evidence array<struct<evidence_id, as_of, ...>>, claims array<struct<text, evidence_ids>>.
    """
    ids, refs = F.col("evidence.evidence_id"), F.flatten("claims.evidence_ids")
    out = cards.select(
        card_id,
        F.size(F.array_except(refs, ids)).cast("long").alias("unknown_references"),
        (F.size(ids) - F.size(F.array_distinct(ids))).cast("long").alias("duplicate_ids"),
        F.size(F.filter("evidence", lambda e: e["as_of"] > F.col("as_of"))).cast("long").alias("late_evidence"),
        (F.col("as_of") > F.lit(now).cast("timestamp")).alias("from_future"),
    )
    return out.withColumn("ok", (F.col("unknown_references") + F.col("duplicate_ids") + F.col("late_evidence") == 0) & ~F.col("from_future"))


def research_score(cards: DataFrame, *, card_id: str = "card_id") -> DataFrame:
    """Passed, score, hard_failures of each card, and the figures they rest on: 15 points off for each failure, 3 for a warning.

    cards: as_of, core, bull, bear, facts, inferences: array<struct<text, evidence_ids, counter_ids>>; evidence:
    array<struct<evidence_id, source_id, quality, as_of>>; invalidation, risks: array<string>.
    """
    known = F.array_distinct(F.transform(F.filter("evidence", lambda e: e["quality"].isin("A", "B", "C")), lambda e: F.substring_index(e["source_id"], ":", 1)))
    # what several codes rest on is a column of its own, computed once; claims are looked at one by one only where some reference is unknown
    cards = cards.withColumns({"__ids": F.col("evidence.evidence_id"), "__claims": F.concat("core", "bull", "bear"), "__domains": F.array_remove(known, "")})
    cards = cards.withColumn("__unknown", F.array_except(F.flatten(F.transform("__claims", lambda c: c["evidence_ids"])), F.col("__ids")))
    named = F.filter("__claims", lambda c: F.size(c["evidence_ids"]) > 0)
    proven = F.filter(named, lambda c: F.size(F.array_except(c["evidence_ids"], F.col("__ids"))) == 0)
    supported = F.when(F.size("__unknown") == 0, F.size(named)).otherwise(F.size(proven))
    cards = cards.withColumn("__cover", F.when(F.size("__claims") > 0, F.least(F.lit(100.0), supported / F.size("__claims") * 100)).otherwise(0.0))
    cover, domains = F.col("__cover"), F.col("__domains")
    fact_refs = F.size(F.flatten(F.transform("facts", lambda c: c["evidence_ids"])))
    late = F.size(F.filter("evidence", lambda e: e["as_of"] > F.col("as_of")))
    codes = [
        (F.size("bear") < 2, "BEAR_CASE_LT_2"), (F.size("bull") < 2, "BULL_CASE_LT_2"), (F.size(domains) < 2, "EVIDENCE_DOMAINS_LT_2"), (late > 0, "FUTURE_EVIDENCE"),
        (F.size("invalidation") == 0, "MISSING_INVALIDATION"), (F.size("risks") == 0, "MISSING_RISK"), (cover < 95, "STRONG_CLAIM_COVERAGE_LT_95"),
        (F.size("__unknown") > 0, "UNKNOWN_EVIDENCE_REFERENCE"), ((F.size("facts") > 0) & (fact_refs < F.size("facts")), "UNSUPPORTED_CONFIRMED_FACT"),
    ]
    failures = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in codes]))
    countered = F.size(F.filter("inferences", lambda c: F.size(c["counter_ids"]) > 0))
    warnings = F.when((F.size("inferences") > 0) & (countered == 0), 1).otherwise(0)
    out = cards.select(card_id, failures.alias("hard_failures"), warnings.alias("warnings"), F.size(domains).cast("long").alias("evidence_domains"), F.round(cover, 2).alias("claim_coverage"))
    return out.withColumn("passed", F.size("hard_failures") == 0).withColumn("score", F.greatest(F.lit(0.0), 100.0 - 15 * F.size("hard_failures") - 3 * F.col("warnings")))


def latest_cards(cards: DataFrame, *, card_id: str, symbol: str, as_of: str) -> DataFrame:
    """(symbol, card_id, as_of) of each symbol's latest card, of equal instants the greatest id; cut in each task before they meet."""
    best = cards.groupBy(symbol).agg(F.max(F.struct(as_of, card_id)).alias("__b"))
    return best.select(symbol, F.col(f"__b.{card_id}").alias(card_id), F.col(f"__b.{as_of}").alias(as_of))


def qualified(cards: DataFrame, scores: DataFrame, *, card_id: str, symbol: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Each symbol's latest card if it passed, by score; and the rejected ones with their reasons. Scores are needed of the latest cards only."""
    both = latest_cards(cards, card_id=card_id, symbol=symbol, as_of=as_of).join(scores, card_id)
    return both.where("passed").select(symbol, card_id, "score"), both.where("NOT passed").select(symbol, card_id, "hard_failures")


def bundle_checks(bundles: DataFrame, *, bundle_id: str = "bundle_id") -> DataFrame:
    """For each bundle: items whose hash is wrong, items after the cutoff, duplicate ids, conflicts with unknown ids, time order, ok.

    bundles: as_of, data_cutoff, evidence array<struct<evidence_id, as_of, body, content_hash>>, conflicts array<array<string>>.
    """
    ids = F.col("evidence.evidence_id")
    out = bundles.select(
        bundle_id,
        F.size(F.filter("evidence", lambda e: F.sha2(e["body"], 256) != e["content_hash"])).cast("long").alias("wrong_hashes"),
        F.size(F.filter("evidence", lambda e: e["as_of"] > F.col("data_cutoff"))).cast("long").alias("late_items"),
        (F.size(ids) - F.size(F.array_distinct(ids))).cast("long").alias("duplicate_ids"),
        F.size(F.array_except(F.flatten("conflicts"), ids)).cast("long").alias("unknown_conflicts"),
        (F.col("data_cutoff") <= F.col("as_of")).alias("in_order"),
    )
    return out.withColumn("ok", F.col("in_order") & (F.col("wrong_hashes") + F.col("late_items") + F.col("duplicate_ids") + F.col("unknown_conflicts") == 0))


def role_checks(results: DataFrame, evidence: DataFrame, roles: Sequence[str], *, result_id: str = "result_id") -> DataFrame:
    """For each result: roles complete (each exactly once), claims with unknown references, facts without evidence, ranks outside 1 to 5, ok.

    results: result_id, roles array<struct<role, claims array<struct<kind, rank, evidence_ids>>>>; evidence: evidence_ids of each result.
    """
    joined = results.join(evidence, result_id, "left")
    claims = F.flatten(F.transform("roles", lambda r: r["claims"]))
    known = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    out = joined.select(
        result_id,
        (F.array_sort("roles.role") == F.array(*[F.lit(r) for r in sorted(roles)])).alias("roles_complete"),
        F.size(F.filter(claims, lambda c: F.size(F.array_except(c["evidence_ids"], known)) > 0)).cast("long").alias("unknown_references"),
        F.size(F.filter(claims, lambda c: (c["kind"] == "FACT") & (F.size(c["evidence_ids"]) == 0))).cast("long").alias("bare_facts"),
        F.size(F.filter(claims, lambda c: ~c["rank"].between(1, 5))).cast("long").alias("bad_ranks"),
    )
    return out.withColumn("ok", F.col("roles_complete") & (F.col("unknown_references") + F.col("bare_facts") + F.col("bad_ranks") == 0))


def table_hash(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """A hash of the rows in whatever order: (keys, input_hash, n_rows).

    Each row has a SHA-256 of its columns by name (as text, nulls apart); eight sums of its 32-bit words and the number of rows are
    hashed once more. Sums are added where rows are, so a table of any size moves a row for each task, and repeated rows count.
    """
    cells = [F.concat_ws("=", F.lit(c), F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))) for c in sorted(df.columns)]
    leaf = df.select(*keys, F.sha2(F.concat_ws("|", *cells), 256).alias("__h"))
    words = [F.sum(F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"__{i}") for i in range(8)]
    sums = leaf.groupBy(*keys).agg(*words, F.count("*").alias("n_rows"))
    return sums.select(*keys, F.sha2(F.concat_ws(",", *[F.coalesce(F.col(f"__{i}"), F.lit(0)).cast("string") for i in range(8)], F.col("n_rows").cast("string")), 256).alias("input_hash"), "n_rows")


def research_gate(orders: DataFrame, cards: DataFrame, scores: DataFrame, *, order_id: str, symbol: str, at: str, version: str, statuses: Sequence[str] = ("ACTIVE",)) -> DataFrame:
    """For each order the symbol's latest card before it: exists, the order is bound to it (its version is that card_id), not expired, allowed status, quality passed, and all of them.

    Cards and orders of a symbol are one stream by time, in which a running maximum is the latest card. Card times and order times are of one type.
    """
    passed = scores.select("card_id", "passed")
    told = cards.where(F.col("as_of").isNotNull()).join(passed, "card_id", "left").select(F.col(symbol).alias("__s"), F.col("as_of").alias("__at"), F.lit(0).alias("__ask"), F.struct("as_of", "card_id", "expires_at", "status", "passed").alias("__c"))
    asks = orders.select(F.col(symbol).alias("__s"), F.col(at).alias("__at"), F.lit(1).alias("__ask"), F.struct(F.col(order_id).alias("id"), F.col(version).alias("v")).alias("__o"))
    stream = Window.partitionBy("__s").orderBy("__at", "__ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = told.unionByName(asks, allowMissingColumns=True).withColumn("b", F.max("__c").over(stream)).where("__ask = 1")
    usable = F.col("__s").isNotNull() & F.col("__at").isNotNull()
    out = latest.select(F.col("__o.id").alias(order_id), "__at", F.col("__o.v").alias("__v"), F.when(usable, F.col("b")).alias("b"))

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    made = out.select(order_id, F.col("b").isNotNull().alias("exists"), flag(F.col("b.card_id") == F.col("__v")).alias("latest"), flag(F.col("b.expires_at") > F.col("__at")).alias("unexpired"), flag(F.col("b.status").isin(*statuses)).alias("allowed"), flag(F.col("b.passed")).alias("quality"))
    return made.withColumn("open", F.col("exists") & F.col("latest") & F.col("unexpired") & F.col("allowed") & F.col("quality"))


def directory_snapshots(captures: DataFrame, *, url: str, at: str, html: str, name: str = r"(?is)<td[^>]*>\s*\d+\s*</td>\s*<td[^>]*>(.*?)</td>") -> DataFrame:
    """Url, captured_at, digest, number, name: numbered names of each distinct content, stamped with its first capture."""
    digest = captures.withColumn("digest", F.sha2(html, 256))
    first = digest.groupBy(url, "digest").agg(F.min(at).alias("captured_at"), F.min_by(html, at).alias("__h"))
    names = F.regexp_extract_all("__h", F.lit(name), F.lit(1))
    rows = first.select(url, "captured_at", "digest", F.posexplode(names).alias("number", "name"))
    return rows.withColumn("number", F.col("number") + 1).withColumn("name", compact(F.regexp_replace("name", r"<[^>]*>", "")))
