"""What is done with violations: positions, statistics, weights, annotated text, conflicts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import rules


def rule_name(rule_id: Column) -> Column:
    return F.regexp_replace(rule_id, "_issue", "")


def weight(rule: Column) -> Column:
    pairs = [F.lit(x) for kv in L.RULE_WEIGHTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rule), F.lit(L.DEFAULT_WEIGHT))


def cost(w: Column) -> Column:
    pairs = [F.lit(x) for kv in L.VIOLATION_COST.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), w), F.lit(L.DEFAULT_COST))


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of ``rules.found_in`` for one batch of documents after the other."""
    held: list[pa.RecordBatch] = []
    for part in batches:
        number = part["batch"].to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and held[-1]["batch"][0].as_py() != number[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _of_each(docs: DataFrame, keep: Sequence[str], texts: bool) -> DataFrame:
    about = F.to_json(F.struct(*keep)) if keep else F.lit("")
    return rules.found_in(docs.select("doc_id", "text", about.alias("about")), texts=texts)


def _with_kept(out: DataFrame, docs: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    kind = docs.select(*keep).schema if keep else None
    own = [F.from_json("about", kind)[k].alias(k) for k in keep] if kind is not None else []
    return out.select("doc_id", *columns, *own)


def statistics(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, total, unique ((rule, term) pairs), by_rule (map), weighted of each row of ``docs`` (doc_id, text, ...) with violations, and its columns ``keep``.

    A document is counted where it was read, so nothing is shuffled, and rows that share a doc_id stay apart.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_batch(batches):
            about = dict(zip(*(t.filter(pc.equal(t["rule"], ""))[c].to_pylist() for c in ("row", "message")), strict=True))
            t = t.filter(pc.not_equal(t["rule"], ""))
            term = t.group_by(["row", "doc_id", "rule", "term"]).aggregate([([], "count_all")])
            rule = term.group_by(["row", "doc_id", "rule"]).aggregate([("count_all", "sum"), ("count_all", "count")]).sort_by([("row", "ascending"), ("rule", "ascending")])
            row, n, u = (rule[c].to_numpy() for c in ("row", "count_all_sum", "count_all_count"))
            first = np.flatnonzero(np.diff(row, prepend=-1))
            if not len(first):
                continue
            name = rule["rule"].combine_chunks()
            price = np.array([_price(x) for x in name.to_pylist()])
            by_rule = pa.MapArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), name, pa.array(n, pa.int32()))
            sums = [pa.array(np.add.reduceat(x, first), pa.int64()) for x in (n, u)]
            yield pa.RecordBatch.from_arrays([rule["doc_id"].combine_chunks().take(pa.array(first)), *sums, by_rule, pa.array(np.add.reduceat(n * price, first), pa.int64()), pa.array([about.get(r) for r in row[first].tolist()], pa.string())], names=["doc_id", "total", "unique", "by_rule", "weighted", "about"])

    found = _of_each(docs, keep, bool(keep)).select("row", "batch", "doc_id", "rule", "term", "message")
    out = found.mapInArrow(count, "doc_id bigint, total bigint, unique bigint, by_rule map<string,int>, weighted bigint, about string")
    return _with_kept(out, docs, keep, ("total", "unique", "by_rule", "weighted"))


def _price(rule: str) -> int:
    return L.VIOLATION_COST.get(L.RULE_WEIGHTS.get(rule, L.DEFAULT_WEIGHT), L.DEFAULT_COST)


def weights(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """text, the columns ``keep`` (whole numbers) and weighted, as ``statistics`` has it, of every row of ``docs`` (text, ...), 0 without violations. Nothing is shuffled, and no message is made."""
    keep = tuple(keep)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_batch(batches):
            whole = t.filter(t["is_text"])
            row, cost = t["row"].to_numpy(), t["cost"].to_numpy()
            of = row - whole["row"][0].as_py()  # rows of a batch have consecutive numbers
            sums = np.bincount(of, cost, whole.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([whole["text"].combine_chunks(), *(whole[c].combine_chunks() for c in keep), pa.array(sums)], names=["text", *keep, "weighted"])

    return rules.priced(docs, _price, keep).mapInArrow(add, ", ".join(["text string", *(f"{c} bigint" for c in keep), "weighted bigint"]))


def resolved(issues: DataFrame) -> DataFrame:
    """Position of each issue (message, text): the one its message states if it lies in the text, else the first place of a quoted term between non-letters.

    Adds p_start and p_end, null where there is none.
    """
    x = issues.withColumn("_a", F.expr(r"try_cast(nullif(regexp_extract(message, r'Text-Position:\s*([0-9]+)-([0-9]+)', 1), '') AS INT)")).withColumn("_b", F.expr(r"try_cast(nullif(regexp_extract(message, r'Text-Position:\s*([0-9]+)-([0-9]+)', 2), '') AS INT)"))
    stated = (F.col("_a") < F.length("text")) & (F.col("_a") < F.col("_b")) & (F.col("_b") <= F.length("text"))
    edge = r"[^\p{L}0-9_]"
    places = F.expr(
        f"""filter(flatten(transform(regexp_extract_all(message, '"([^"]+)"', 1), (q, k) ->
          transform(filter(sequence(1, greatest(1, length(text))), i -> substring(lower(text), i, length(q)) = lower(q) AND length(q) > 0 AND regexp_like(substring(concat(' ', text, ' '), i, 1), r'^{edge}') AND regexp_like(substring(concat(' ', text, ' '), i + length(q) + 1, 1), r'^{edge}')),
            i -> named_struct('k', k, 's', i - 1, 'e', i - 1 + length(q))))), z -> z.e <= length(text))"""
    )
    first = F.get(F.array_sort(places), F.lit(0))
    return x.withColumn("_f", first).select(*issues.columns, F.when(stated, F.col("_a")).otherwise(F.col("_f.s")).alias("p_start"), F.when(stated, F.col("_b")).otherwise(F.col("_f.e")).alias("p_end"))


def inserted(text: str, marks: list[tuple[int, str]]) -> str:
    """``text`` with each mark after the place where it ends; places ascend. One pass, however many marks there are."""
    at, out = 0, []
    for end, mark in marks:
        out += (text[at:end], mark)
        at = end
    return "".join([*out, text[at:]])


def annotated_documents(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, annotated (the text with [rule: term] behind each violation that has a place) of each row of ``docs`` (doc_id, text, ...), and its columns ``keep``. Nothing is shuffled; rows that share a doc_id stay apart."""

    def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_batch(batches):
            whole = t.filter(pc.equal(t["rule"], ""))
            marks: dict[int, list[tuple]] = {}
            for row, *mark in zip(*(t.filter(pc.is_valid(t["t_end"]))[c].to_pylist() for c in ("row", "t_end", "t_start", "rule", "term", "message")), strict=True):
                marks.setdefault(row, []).append(mark)
            texts = whole["term"].to_pylist()
            said = [text if text is None else inserted(text, [(m[0], f"[{m[2]}: {m[3]}]") for m in sorted(marks.get(row, []))]) for row, text in zip(whole["row"].to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([whole["doc_id"].combine_chunks(), pa.array(texts, pa.string()), pa.array(said, pa.string()), whole["message"].combine_chunks()], names=["doc_id", "text", "annotated", "about"])

    found = _of_each(docs, keep, True).select("row", "batch", "doc_id", "rule", "t_start", "t_end", "term", "message")
    return _with_kept(found.mapInArrow(annotate, "doc_id bigint, text string, annotated string, about string"), docs, keep, ("text", "annotated"))


def annotated(text: Column, marks: Column) -> Column:
    """``text`` with [rule: term] at the end of each mark (array of struct(ord, rule, term, end)); marks at one place in their order."""
    # from the last place to the first, so that offsets stay right
    order = F.array_sort(F.transform(marks, lambda m: F.struct((-m["end"]).alias("back"), (-m["ord"]).alias("o"), m["rule"].alias("rule"), m["term"].alias("term"), m["end"].alias("end"))))
    return F.aggregate(order, text, lambda t, m: F.concat(F.substring(t, F.lit(1), m["end"]), F.lit("["), m["rule"], F.lit(": "), m["term"], F.lit("]"), F.substring(t, m["end"] + 1, F.length(t))))


def grouped_by_position(issues: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Issues in the order in which their position first occurs, then their own (``ord``); adds ``place``. Issues without position stand alone."""
    key = F.when(F.col("start").isNull() | F.col("end").isNull(), F.concat(F.lit("o"), "ord")).otherwise(F.concat_ws("-", "start", "end"))
    first = F.min("ord").over(Window.partitionBy(doc, key))
    return issues.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(first, "ord")))


def conflicts(issues: DataFrame) -> DataFrame:
    """Pairs of a document's issues with the same text and different rules, or with overlapping spans."""
    a, b = issues.alias("a"), issues.alias("b")
    same = (F.col("a.text") != "") & (F.col("a.text") == F.col("b.text")) & (F.col("a.rule") != F.col("b.rule"))
    overlap = (F.col("a.end") > F.col("b.start")) & (F.col("b.end") > F.col("a.start"))
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.ord") < F.col("b.ord")) & (same | F.coalesce(overlap, F.lit(False)))).select(F.col("a.doc_id").alias("doc_id"), F.col("a.ord").alias("ord1"), F.col("b.ord").alias("ord2"))


def difficulty(text: Column, rule: Column, message: Column) -> Column:
    """fixable or difficult, by what the message offers and what kind of word it is."""
    named = rule.isin("komposita", "kurze_woerter", "fremdwoerter") & text.rlike(r"^\p{Lu}")
    inner = text.rlike(r"^.[^\n]*[\p{Lu}-]") | ((F.length(text) > 5) & text.rlike("(berg|burg|dorf|heim|tal)$"))
    return (
        F.when(T.suggestion(message).isNotNull(), "fixable")
        .when(named & inner, "difficult")
        .when(rule.isin(*L.EASY_RULES), "fixable")
        .when(rule.isin(*L.HARD_RULES), "difficult")
        .otherwise("fixable")
    )


def instruction(rule: Column, message: Column, text: Column) -> Column:
    """The suggestion a message offers, else the rule's own template, else null."""
    word = F.coalesce(T.first_quoted(message), text)
    pairs = [F.lit(x) for kv in L.FALLBACK_INSTRUCTIONS.items() for x in kv]
    template = F.try_element_at(F.create_map(*pairs), rule)
    return F.coalesce(
        F.concat(F.lit('Ersetze "'), word, F.lit('" durch "'), T.suggestion(message), F.lit('"')),
        F.replace(template, F.lit("{word}"), F.substring(F.coalesce(word, F.lit("")), 1, 30)),
    )
