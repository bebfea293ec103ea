"""Where things come from and whether they still are what they were: envelopes, locators, snapshots, listings, packets' files,
definitions, the age of evidence. Every check is a join of what is claimed with what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.control import first_code

# Limits of envelopes and artifacts.
MAX_RATIO, MAX_FILES, MAX_ARTIFACT_BYTES = 200, 64, 32_000_000


def check_envelope(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(envelope, path, code) of all members that an envelope lists and all entries that it holds.

    members: envelope, path, size, sha256, git_sha1; entries: envelope, path, size, packed, regular, sha256, git_sha1."""
    twice = entries.groupBy("envelope", "path").agg(F.count("*").alias("n"), F.first(F.struct("size", "packed", "regular", "sha256", "git_sha1")).alias("e"))
    j = members.join(twice, ["envelope", "path"], "full")
    code = first_code(
        ("MEMBER_MISSING", F.col("n").isNull()),
        ("MEMBER_NOT_LISTED", F.col("size").isNull()),
        ("MEMBER_AMBIGUOUS", F.col("n") > 1),
        ("MEMBER_MODE", ~F.col("e.regular")),
        ("MEMBER_SIZE_OR_RATIO", (F.col("e.size") != F.col("size")) | (F.col("e.size") > MAX_RATIO * F.greatest(F.col("e.packed"), F.lit(1)))),
        ("MEMBER_CHANGED", (F.col("e.sha256") != F.col("sha256")) | (F.col("e.git_sha1") != F.col("git_sha1"))),
    )
    return j.select("envelope", "path", code.alias("code"))


def envelope_status(checked: DataFrame) -> DataFrame:
    """(envelope, members_verified, status): verified if every path is."""
    bad = F.count_if(F.col("code") != "OK")
    return checked.groupBy("envelope").agg(F.count_if(F.col("code") == "OK").alias("members_verified"), F.when(bad == 0, "PINNED_SELECTED_BYTES_VERIFIED").otherwise("REFUSED").alias("status"))


def read_located(locators: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, code, content): the bytes that a locator names, if they are the source's.

    locators: source_id, path, member; sources: source_id, sha256, archive_sha256; files: path, member ('' for a file), sha256,
    archive_sha256, content."""
    have = files.select("path", "member", F.col("sha256").alias("_sha"), F.col("archive_sha256").alias("_archive"), "content")
    j = sources.join(locators, "source_id", "left").join(have, ["path", "member"], "left")
    code = first_code(
        ("LOCATOR_MISSING", F.col("path").isNull()),
        ("SOURCE_NOT_READ", F.col("_sha").isNull()),
        ("ARCHIVE_VERSION_MISMATCH", (F.col("member") != "") & ~F.col("_archive").eqNullSafe(F.col("archive_sha256"))),
        ("SOURCE_VERSION_MISMATCH", F.col("_sha") != F.col("sha256")),
    )
    j = j.withColumn("code", code)
    return j.select("source_id", "code", F.when(F.col("code") == "OK", F.col("content")).alias("content"))


def compare_snapshots(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of what changed between two listings (key, sha256) of the same place."""
    j = before.select(key, F.col("sha256").alias("_a")).join(after.select(key, F.col("sha256").alias("_b")), key, "full")
    change = F.when(F.col("_a").isNull(), "APPEARED").when(F.col("_b").isNull(), "DISAPPEARED").when(F.col("_a") != F.col("_b"), "CHANGED")
    return j.select(key, change.alias("change")).where("change IS NOT NULL")


def list_runs(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(run, status): every run; one whose receipt is missing or doesn't fit is marked, not left out."""
    j = runs.join(receipts.select("run", F.col("sha256").alias("_receipt")), "run", "left")
    return j.select("run", F.when(F.col("_receipt") == F.col("sha256"), F.col("status")).otherwise("BLOCKED_INVALID_REPORT").alias("status"))


def preflight(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(contract, files, bytes, status): the artifacts that a contract lists, held against the bytes that are there."""
    j = artifacts.join(files.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha")), "path", "left")
    code = first_code(("ARTIFACT_READ", F.col("_size").isNull()), ("ARTIFACT_MISMATCH", (F.col("_size") != F.col("size")) | (F.col("_sha") != F.col("sha256"))))
    g = j.groupBy("contract").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.countDistinct("path").alias("paths"), F.count_if(code == "ARTIFACT_READ").alias("lost"), F.count_if(code == "ARTIFACT_MISMATCH").alias("wrong"))
    status = first_code(
        ("ARTIFACT_COUNT", F.col("files") > MAX_FILES),
        ("ARTIFACT_BYTES", F.col("bytes") > MAX_ARTIFACT_BYTES),
        ("ARTIFACT_DUPLICATE", F.col("paths") < F.col("files")),
        ("ARTIFACT_READ", F.col("lost") > 0),
        ("ARTIFACT_MISMATCH", F.col("wrong") > 0),
        otherwise="SELECTED_ARTIFACT_BYTES_VERIFIED",
    )
    return g.select("contract", "files", "bytes", status.alias("status"))


def inspect_definitions(definitions: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, name, start_line, code): definitions (source_id, name, start_line, end_line, sha256) held against the lines of sources
    (source_id, code) as they are now."""
    text = F.regexp_replace("code", "\r\n?", "\n")
    body = F.array_join(F.slice(F.split(text, "\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    j = definitions.join(sources.select("source_id", "code"), "source_id", "left")
    code = first_code(("SOURCE_GONE", F.col("code").isNull()), ("DEFINITION_CHANGED", F.sha2(body, 256) != F.col("sha256")), otherwise="EXACT_BYTES_VERIFIED")
    return j.select("source_id", "name", "start_line", code.alias("code"))


def evidence_age(evidence: DataFrame, sources: DataFrame, as_of: Column, most_days: int) -> DataFrame:
    """evidence (.., source) with kind, age_days, fresh and origin group of its source."""
    s = sources.select("source", "kind", F.datediff(as_of, "observed_on").cast("long").alias("age_days"), "origin_group")
    return evidence.join(s, "source").withColumn("fresh", F.col("age_days") <= most_days)


def code_of_intake(kind: Column, extension: Column, size: Column, readable: Column) -> Column:
    """How a research source is taken in: as code, as text in chunks, or not."""
    text = ["md", "txt", "rst"]
    return first_code(
        ("REFERENCE_TEXT_LIMIT", (kind != "implementation") & (size > 250_000)),
        ("REFERENCE_ENCODING", (kind != "implementation") & ~readable),
        ("REFERENCE_INDEXED", kind != "implementation"),
        ("CODE_INDEXED", extension.isin("py", "pyi", "pyw", "zip", "ipynb", *text)),
        ("TEXT_FALLBACK_LIMIT", size > 250_000),
        ("UNSUPPORTED_BINARY", ~readable),
        otherwise="TEXT_ONLY_UNSUPPORTED_LANGUAGE",
    )


def catalog(modules: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (source_id, observation_id, sha256) and cards (card_id, source_id, observation_id, name, start, end) of pinned modules."""
    sha = F.sha2("code", 256)
    sources = modules.select("source_id", F.concat(F.lit("observation_"), F.sha2(F.concat_ws("|", "source_id", sha), 256)).alias("observation_id"), sha.alias("sha256"))
    card = F.concat(F.lit("card_"), F.sha2(F.concat_ws("|", "source_id", "name", "definition_line", "end_line", "observation_id"), 256))
    cards = definitions.join(sources.hint("merge"), "source_id").select(card.alias("card_id"), "source_id", "observation_id", "name", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return sources, cards


def note_source(text: Column, name: Column, today: Column) -> Column:
    """A plain note as a first-hand source record; its key comes from its file name."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*?)(\.[^./]*)?$", 1), "[^A-Za-z0-9_-]+", "-")
    key = F.substring(F.regexp_replace(stem, "^[-_]+|[-_]+$", ""), 1, 60)
    key = F.when(key == "", "notes").when(key.rlike("^[A-Za-z0-9]"), key).otherwise(F.concat(F.lit("n"), key))
    return F.struct(F.concat(F.lit("notes-"), key).alias("id"), text.alias("text"), F.lit("firsthand").alias("kind"), F.lit("local-notes").alias("origin_group"), F.concat(F.lit("file-ref://local/"), key).alias("uri"), today.alias("observed_on"))


def refusal_codes(sources: DataFrame, pattern: str = r"raise Refused\(\"([A-Z_0-9]+)\"\)") -> DataFrame:
    """(code, sources): the literal refusal codes that source texts raise, and in how many sources."""
    found = sources.select("source_id", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)))).alias("refusal"))
    return found.groupBy(F.col("refusal").alias("code")).agg(F.count("*").alias("sources"))


def resolve_relative(source_id: Column, target: Column) -> Column:
    """The full dotted name of a relative import target (.a.b, ..c) in a source; null where it leaves the package. Others stay."""
    dots = F.length(F.regexp_extract(target, r"^\.*", 0))
    package = F.slice(F.split(F.regexp_replace(source_id, r"\.(py|pyi|pyw)$", ""), "/"), 1, F.greatest(F.size(F.split(source_id, "/")) - dots, F.lit(0)).cast("int"))
    full = F.concat_ws(".", package, F.regexp_replace(target, r"^\.+", ""))
    return F.when(dots == 0, target).when(dots <= F.size(F.split(source_id, "/")) - 1, full)
