"""Text cut off by field limits: strict prefixes of longer copies, found by sorting."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.sources.tables import cut

#: A length is a limit of its source where this share of the distinct texts of that length, and so many, are found cut without it.
LIMIT_SHARE, LIMIT_TEXTS = 0.8, 5
#: Values a task remembers, so that what many texts hold goes out once; then it starts anew.
SEEN = 500_000
#: Texts, about, whose values tell where the partitions of the order begin; they decide nothing else.
SAMPLED = 1000
#: Fewest letters of a cut word: shorter ones begin too many words to tell anything.
WORD = 4
_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_GIT = re.compile(r"diff --git a/(\S+) b/(\S+)\Z")
_SENTENCE = re.compile(r"(?<=[.!?]) +")
_WORDS = re.compile(rf"\w{{{WORD},}}")
_CUT_WORD = re.compile(rf"(?<!\w)[^\W\d]{{{WORD},}}\Z")
_ELLIPSIS = re.compile(r"\s*(?:…|\.\.\.)\Z")
_TRAILER = re.compile(r"(?:Refs: (?:[0-9a-f]{0,39})|Signed-off-by: [^<>]*(?:<[^>]*)?)\Z")
_HEADER = re.compile(r"commit [0-9a-f]*\Z|commit [0-9a-f]{40}\nA|From [0-9a-f]*\Z|From [0-9a-f]{40}\nF")


def unwrap(text: str) -> tuple[str, str, bool]:
    """Message and diff of a commit without what its feed wraps around them, and whether the wrapping itself is cut."""
    at = 0 if text.startswith("diff --git ") else text.find("\ndiff --git ") + 1
    message, diff = (text[:at], text[at:]) if at or text.startswith("diff --git ") else (text, "")
    broken = False
    if message.startswith("commit ") and _HEADER.match(message):
        head, gap, message = message.partition("\n\n")
        broken = not gap
        message = "\n".join(x.removeprefix("    ") for x in message.split("\n"))
    elif message.startswith("From ") and _HEADER.match(message):
        head, gap, message = message.partition("\nSubject: ")
        broken = not gap or not diff and "\n---" not in message
        message = message.removeprefix("[PATCH] ")
        message = re.sub(r"\n+---\n*\Z", "", message)
    return message.strip("\n"), diff, broken


def diff_open(diff: str) -> bool:
    """True if a unified diff stops inside a file's header, inside a hunk, or within its last line's syntax."""
    old = new = 0
    head = None  # lines of the file header that have come, None outside one
    lines = diff.removesuffix("\n").split("\n")
    for k, line in enumerate(lines):
        if old > 0 or new > 0:
            c = line[:1]
            old -= c != "+" and c != "\\"
            new -= c != "-" and c != "\\"
            continue
        if m := _HUNK.match(line):
            old, new, head = int(m[1] or 1), int(m[2] or 1), None
        elif line.startswith("diff --git "):
            if not (m := _GIT.match(line)):
                return k == len(lines) - 1
            if k == len(lines) - 1 and m[1] != m[2]:
                return True
            head = m[2]
        elif line.startswith(("Binary files ", "GIT binary patch", "rename to ", "deleted file mode")):
            if k == len(lines) - 1 and line.startswith("Binary files ") and not line.endswith(" differ"):
                return True
            head = None
        elif line.startswith("@@") or k == len(lines) - 1 and len(line) > 1 and "diff --git ".startswith(line):
            return True
    return old > 0 or new > 0 or head is not None


def broken_tail(message: str) -> bool:
    """True if the last line of a message that has no diff is a cut trailer, diff header or path."""
    before, _, line = message.rpartition("\n")
    if _TRAILER.match(line) and line.startswith(("Refs: ", "Signed-off-by: ")):
        return True
    if "diff --git ".startswith(line) and (len(line) > 3 or line and before.rstrip("\n").endswith("\n---")):
        return True
    return line.startswith("#\t") and "." not in line.rsplit("/", 1)[-1]


def sentences(line: str) -> list[str]:
    """Sentences of a line without what ends them, so one that lacks its full stop is the same sentence."""
    return [x.rstrip(".!?:") for x in _SENTENCE.split(line) if x.rstrip(".!?:")]


def digest(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def code(line: str) -> str:
    """A line of a diff without its marker and indentation."""
    return line[1:].lstrip() if line[:1] in ("+", "-") else line.lstrip()


def units(text: str, commit: str | None, ends_only: bool = False) -> tuple[list[str], list[str], bool, bool]:
    """What a text brings to the self-join: whole values, ends that may be cut, whether its syntax is open, whether it is a subject alone.

    The first letter of a value tells its kind: ``b`` the body after its commit, ``s`` a sentence of the message, ``l`` a
    line of the diff without its marker and indentation, ``w`` a word. Ends: the body, and of a text that may go on its
    last sentence or line and its last word; a diff whose hunks are complete does not go on.
    """
    message, diff, broken = unwrap(text)
    body = f"{message}\n\n{diff}".rstrip("\n ") if diff else message.rstrip("\n ")
    is_open = broken or (diff_open(diff) if diff else broken_tail(message))
    whole, ends = [], [f"b{commit or ''}\n{body}"]
    goes_on, head, lines = "", body, []
    if diff:
        lines = diff.split("\n")
        if is_open:
            goes_on = lines.pop()
            head = text[: len(text) - len(goes_on)]
            if len(x := code(goes_on)) > 2:
                ends.append("l" + x)
        said = message.split("\n")
    else:
        *said, last = message.split("\n")
        *done, goes_on = _SENTENCE.split(last)
        dots = _ELLIPSIS.search(goes_on)
        said += done
        goes_on = goes_on[: dots.start()] if dots else goes_on
        if goes_on and goes_on[-1].isalnum():
            head = message[: message.rfind(goes_on)]
            # After an ellipsis only a cut inside a word tells: a whole text may end with one.
            ends.append(("t" if dots else "s") + goes_on)
        else:
            said.append(goes_on)
            goes_on = ""
    last = _CUT_WORD.search(goes_on)
    if last and ("\n" in body or last.group().islower()):
        ends.append("w" + last.group())
    if not ends_only:
        whole = ["l" + x for x in map(code, lines) if len(x) > 2]
        whole += ["s" + x for line in said for x in sentences(line)]
        whole += ["w" + x for x in {*_WORDS.findall(head), *_WORDS.findall(goes_on[: last.start() if last else None])}]
    return whole, ends, is_open, "\n" not in body


def _documents(id_type: str):
    """Each document's lengths, open syntax and the digests of its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                for text, commit in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    _, ends, is_open, subject = units(text, commit, ends_only=True)
                    row = (digest(text), len(text.encode("utf-8", "replace")), is_open, subject, [{"kind": e[0], "h": digest("s" + e[1:] if e[0] == "t" else e)} for e in ends])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.struct([("kind", pa.string()), ("h", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:5], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "commit_sha", "source", "chars", "same", "bytes", "open", "subject", "ends"],
            )

    return run, f"doc_id {id_type}, commit_sha string, source string, chars int, same bigint, bytes int, open boolean, subject boolean, ends array<struct<kind: string, h: bigint>>"


def _values(bounds: list[str]):
    """``(value, whole, part)`` of all texts; a value that a task has met lately goes out once. ``part``: how many bounds are not over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[set[int], set[int]] = (set(), set())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece, values, wholes = batch.slice(lo, 256), [], []
                for text, commit in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    whole, ends, _, _ = units(text, commit)
                    for kind, group in ((1, whole), (0, ["s" + e[1:] if e[0] == "t" else e for e in ends])):
                        new = {h: v for v in group if (h := hash(v)) not in seen[kind]}
                        seen[kind].update(new)
                        values += new.values()
                        wholes += [kind == 1] * len(new)
                if len(seen[0]) + len(seen[1]) > SEEN:
                    seen[0].clear()
                    seen[1].clear()
                parts = [bisect_right(bounds, v) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(wholes, pa.bool_()), pa.array(parts, pa.int32())], names=["value", "whole", "part"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted values: the ends that the next different value begins with. The first and the last value go out as edges.

    Equal values stand together; they count as whole if one of them is. ``h`` is null for a value that is no end.
    """
    part, names = TaskContext.get().partitionId(), ["part", "edge", "h", "whole", "value", "follows"]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string())
    rows: list[tuple] = []
    before, whole, end, first = None, False, False, None

    def close(value: str | None) -> None:
        if end and value is not None and value.startswith(before):
            rows.append((part, "inner", digest(before), whole, None, value[len(before) : len(before) + 40]))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            piece = batch.slice(lo, 1024)
            for value, is_whole in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                if value != before:
                    if before is None:
                        first = value
                    else:
                        close(value)
                    before, whole, end = value, False, False
                whole, end = whole or is_whole, end or not is_whole
        if rows:
            yield out()
            rows.clear()
    if before is not None:
        rows += [(part, "first", None, None, first, None), (part, "last", digest(before) if end else None, whole, before, None)]
        yield out()


def strict_prefixes(values: DataFrame, partitions: int) -> DataFrame:
    """``(h, whole, follows)`` of each end of ``(value, whole)`` that is a strict prefix of another value, with what comes next there.

    ``h`` is the value's digest, ``whole`` whether it also stands whole somewhere. Values are range-partitioned and sorted,
    so whatever begins with a value stands right behind it: one look at the next value decides, however many values share
    a beginning. ``part``, if there, is the place in that order that a value's partition has. The last value of a partition meets the first of the next one that has any: two rows a partition, put in
    order by a window, however large the data are.
    """
    known = "part" in values.columns
    ordered = values.repartitionById(partitions, F.col("part")).drop("part") if known else values.repartitionByRange(partitions, "value")
    ordered = ordered.sortWithinPartitions("value")
    marks = cut(ordered.mapInArrow(_neighbours, "part int, edge string, h bigint, whole boolean, value string, follows string"))
    inner = marks.filter("edge = 'inner'").select("h", "whole", "follows")
    edges = marks.filter("edge <> 'inner'").withColumn("later", F.lead("value").over(Window.partitionBy(F.lit(0)).orderBy("part", "edge")))
    across = edges.filter("edge = 'last' and h is not null and startswith(later, value)")
    return inner.unionByName(across.select("h", "whole", F.expr("substring(later, char_length(value) + 1, 40)").alias("follows")))


def texts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("text").rlike(r"\S")).select("doc_id", "text", "commit_sha", "source", F.char_length("text").alias("chars"))


def truncated(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(doc_id, source, reason)`` of the documents whose text stops before its end.

    The prefix self-join takes all texts, whole and by parts. Reasons: ``prefix`` - the unwrapped text is a strict prefix of another copy of
    its commit (of any text without commit, if cut inside a word); ``fragment`` - the last sentence of a message or the last line of
    an unfinished diff is a strict prefix of longer ones elsewhere and nowhere complete; ``word`` - so is the last word.
    Exact checks add: ``syntax`` - a diff hunk, file header, trailer or feed header is open; ``limit`` - the text has a
    length, in characters or bytes, at which nearly all of its source's texts are found cut by the reasons before.

    Null, empty and blank texts are no cases; a null source is a source of its own; repeated documents each count; other
    columns are ignored. Equal values are sent once a task, so a line that a third of all texts hold is no hot key.
    """
    spark = df.sparkSession
    partitions = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run, schema = _documents(df.schema["doc_id"].dataType.simpleString())
    rows = cut(texts(df).mapInArrow(run, schema))
    # The values' order is cut by those of some texts, so that all texts are taken apart once, not once more to be sampled.
    schema = "value string, whole boolean, part int"
    some = texts(df).sample(min(1.0, SAMPLED / max(1, rows.count())), 7).mapInArrow(_values([]), schema).select(F.substring("value", 1, 64).alias("value")).limit(100 * SAMPLED)
    cuts = sorted({r.value for r in some.collect()})
    bounds = sorted({cuts[len(cuts) * i // partitions] for i in range(1, partitions)}) if cuts else []
    begun = strict_prefixes(texts(df).mapInArrow(_values(bounds), schema), partitions)

    mid = F.col("follows").rlike(r"^[\p{L}\p{M}\p{N}_]")
    goes_on = F.col("follows").rlike(r"[\p{L}\p{N}]")
    # One feed may add a trailer to the text that another has whole.
    trailer = F.col("follows").rlike(r"^\n+[A-Z][\w-]*: ")
    ends = rows.select("doc_id", "source", "subject", F.col("commit_sha").isNull().alias("alone"), F.explode("ends").alias("e")).select("*", "e.kind", "e.h").drop("e")
    is_cut = (
        F.when(F.col("kind") == "b", goes_on & ~trailer & (~F.col("alone") | mid & ~F.col("subject")))
        .when(F.col("kind") == "s", ~F.col("whole") & goes_on & (mid | ~F.col("subject")))  # a subject can be whole where another goes on
        .when(F.col("kind") == "t", ~F.col("whole") & mid)
        .otherwise(~F.col("whole") & F.col("follows").rlike(r"\S"))
    )
    reason = F.when(F.col("kind") == "b", "prefix").when(F.col("kind") == "w", "word").otherwise("fragment")
    by_prefix = ends.join(begun, "h").filter(is_cut).select("doc_id", "source", reason.alias("reason"))
    by_syntax = rows.filter("open").select("doc_id", "source", F.lit("syntax").alias("reason"))
    found = cut(by_prefix.unionByName(by_syntax).distinct())

    of = F.coalesce("source", F.lit(""))
    sized = rows.join(found.select("doc_id").distinct().withColumn("cut", F.lit(1)), "doc_id", "left").select("doc_id", "source", of.alias("of"), "chars", "bytes", "same", F.coalesce("cut", F.lit(0)).alias("cut"))

    def limits(of_texts: DataFrame, unit: str) -> DataFrame:
        full = of_texts.select("of", unit, "same", "cut").distinct().groupBy("of", unit).agg(F.avg("cut").alias("share"), F.sum("cut").alias("n"))
        return full.filter((F.col("share") >= LIMIT_SHARE) & (F.col("n") >= LIMIT_TEXTS)).select("of", unit)

    in_chars = limits(sized, "chars")
    rest = sized.join(in_chars, ["of", "chars"], "left_anti")
    # A text cut in bytes can end in a character of up to four, dropped or replaced by one of three.
    in_bytes = limits(rest, "bytes").select("of", F.explode(F.sequence(F.col("bytes") - 3, F.col("bytes") + 2)).alias("bytes")).distinct()
    at_limit = sized.join(in_chars, ["of", "chars"], "left_semi").unionByName(rest.join(in_bytes, ["of", "bytes"], "left_semi"))
    by_limit = at_limit.select("doc_id", "source", F.lit("limit").alias("reason"))
    return found.unionByName(by_limit)


def shares(df: DataFrame) -> DataFrame:
    """``(source, n_docs, n_truncated, share)``: how often each source truncates, over its documents that have text."""
    found = truncated(df).select("doc_id", "source").distinct().groupBy("source").agg(F.count("*").alias("n_truncated"))
    all_docs = df.filter(F.col("text").rlike(r"\S")).groupBy("source").agg(F.count("*").alias("n_docs"))
    joined = all_docs.join(found.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    n = F.coalesce("n_truncated", F.lit(0))
    return joined.select("source", "n_docs", n.alias("n_truncated"), F.round(n / F.col("n_docs"), 6).alias("share"))
