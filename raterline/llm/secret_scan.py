"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidate spans.  The candidates' hashes are then counted over
the whole corpus: by document, by repository and by owner.  A value that many owners carry, or
several owners in many repositories, is a widely copied example; a value that one owner
carries, in however many repositories, and that looks random is treated as a live credential.

The counts are plain two-step aggregations (by value, repository and owner, then by value),
so a value that a third of all rows share is summed before it is shuffled; the counts go back
to the spans by a join that Spark can split where one value is hot.

Defined cases: null texts are empty and have no spans; null repositories and owners count as
one unnamed party; repeated rows are each scanned and answered; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterline.llm.common import schema, unused, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Further public formats, beside the three base kinds: (kind, pattern).
FURTHER = (
    ("private", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?")),
    ("forge", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
ORDER = {k: i for i, k in enumerate(("assign", "access", "hex", *(k for k, _ in FURTHER)))}

SCANNED = schema(
    row="long", doc_id="long", repository="string", owner="string", n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string",
    found="array<struct<kind:string,start:int,end:int,value:binary,random:boolean>>",
)
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("random", pa.bool_())]))


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every span, by start, then kind; offsets in code points."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for (kind, pattern), sign in zip(FURTHER, ("PRIVATE KEY", "gh", "eyJ")):
        if sign in text:
            out += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def looks_random(value: str) -> bool:
    """Many different characters, letters and digits mixed, and no character in a long run."""
    distinct = len(set(value))
    return distinct >= min(8, len(value) // 2) and any(c.isdigit() for c in value) and not re.search(r"(.)\1{5}", value)


def scan(docs: DataFrame, *, repository: Column, owner: Column) -> DataFrame:
    """The spans of every document, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(4):
                spans = find(text.as_py() or "")
                base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if ORDER[k] < 3)
                kinds = [k for k, *_ in spans]
                rows.append(
                    (
                        *(kinds.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans),
                        [{"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "random": looks_random(v)} for k, a, b, v in spans],
                    )
                )
            made = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _FOUND)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array(list(x), k) for x, k in zip(made, kinds))], names=SCANNED.names)

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, SCANNED)


def ownership(scanned: DataFrame) -> DataFrame:
    """Per value: how many documents, repositories and owners carry it, over all rows."""
    each = scanned.select("row", "repository", "owner", F.explode(F.array_distinct(F.transform("found", lambda x: x["value"]))).alias("value"))
    by_repository = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_documents"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged_spans(scanned: DataFrame, *, example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """Every span with its value's counts and a verdict.

    example: at least `example_owners` owners carry the value, or two do in at least
    `example_repositories` repositories; live: one owner does and the value looks random;
    unclear: the rest.
    """
    spans = scanned.select("row", "doc_id", F.inline("found"))
    counted = spans.join(ownership(scanned), "value")
    wide = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= example_repositories))
    verdict = F.when(wide, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return counted.withColumn("verdict", verdict)


def scan_secrets(docs: DataFrame, *, repository: Column | None = None, owner: Column | None = None, example_owners: int = 3) -> DataFrame:
    """Per document: span counts by kind, all spans, and how many are live or copied examples.

    The scan's small rows are written to the shared folder, since the counts and the result
    both read them; the texts are read once.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    scanned = written(scan(docs, repository=repository, owner=owner), "secrets")
    per_row = judged_spans(scanned, example_owners=example_owners).groupBy("row").agg(
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories")
    )
    return scanned.drop("found", "repository", "owner").join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories"))
    )


def redact(docs: DataFrame, *, repository: Column | None = None, owner: Column | None = None, mark: str = "<secret>", example_owners: int = 3) -> DataFrame:
    """The documents with every span outside widely copied examples replaced by a mark.

    Documents without such spans come back as they are; n_chars follows the text.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    names = [F.col(f"`{n}`") for n in docs.columns]
    mark_key, mark_cuts, text_at = unused(docs, "row_key"), unused(docs, "row_cuts"), docs.columns.index("text")
    numbered = docs.withColumn(mark_key, F.xxhash64("doc_id", "text"))
    with_key = numbered.select(F.col(mark_key).alias("doc_id"), "text", repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    scanned = written(scan(with_key, repository=F.col("repository"), owner=F.col("owner")), "secrets")
    bad = judged_spans(scanned, example_owners=example_owners).where("verdict != 'example'")
    cuts = bad.groupBy(F.col("doc_id").alias(mark_key)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(mark_cuts))

    def blot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    out, done = [], 0
                    for x in spans:
                        if x["start"] >= done:
                            out += [texts[i][done : x["start"]], mark]
                        done = max(done, x["end"])
                    texts[i] = "".join(out) + texts[i][done:]
            columns = [pa.array(texts, pa.string()) if k == text_at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    marked = numbered.join(cuts, mark_key, "left").select(*names, mark_cuts).mapInArrow(blot, docs.schema)
    return marked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else marked
