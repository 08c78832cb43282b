"""The FASTA data source against a plain reader, at every border of ranges, and its stream across a restart."""

import gzip
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.sources import fasta, genomic


def plain(data: bytes) -> list[tuple[str, str]]:
    out = []
    for line in data.decode().split("\n"):
        if line.startswith(">"):
            out.append([(line[1:].split() or [""])[0], ""])
        elif out:
            out[-1][1] += re.sub(r"\s", "", line).upper()
    return [tuple(x) for x in out]


def by_ranges(data: bytes, piece: int, size: int) -> list[tuple[str, str]]:
    rows = []
    for at in range(0, len(data), size):
        rows += fasta.pieces_of(pa.PythonFile(io.BytesIO(data), "r"), at, min(at + size, len(data)), piece)
    assert len({r[1:3] for r in rows}) == len(rows)  # a place is one piece
    assert all(len(r[3]) <= piece for r in rows)
    records: dict[int, list] = {}
    for contig, record, _, seq in sorted(rows, key=lambda r: r[1:3]):
        assert records.setdefault(record, [contig, ""])[0] == contig
        records[record][1] += seq
    return [tuple(x) for _, x in sorted(records.items())]


CASES = [
    b"", b"\n\n", b">", b">a", b">a\n", b">a\n>b\n>c", b"letters before\n>a\nAC\nGT\n", b">one first > word\r\nACGTnn\r\nacgt\r\n>two\r\nGGG\r\n>empty\r\n",
    b"> spaced name\nAC GT\n\n\n>a\nAC>GT\n", b">a\nAC\n>a\nGT\n>\nTT", b">" + b"x" * 50 + b" tail\n" + b"ACGT" * 20 + b"\n>b\n" + b"\n" * 30 + b"G",
]


@pytest.mark.parametrize("data", CASES)
def test_every_border(data):
    for piece in (1, 2, 3, 7, 64):
        for times in (1, 2, 5):
            assert by_ranges(data, piece, piece * times) == plain(data), (piece, times)


def test_random_files(monkeypatch):
    monkeypatch.setattr(fasta, "BACK", 5)  # the search for a header crosses its own blocks
    rng = random.Random(3)
    for _ in range(300):
        data = "".join(rng.choice((">", "\n", "\n>", "a", "CG", "T\n", " ", "name ")) for _ in range(rng.randrange(60))).encode()
        piece = rng.randrange(1, 9)
        assert by_ranges(data, piece, piece * rng.randrange(1, 4)) == plain(data), (data, piece)


def whole(df):
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "seq"))), lambda x: x["seq"]), "")
    return sorted((r.contig_id, r.seq) for r in df.groupBy("file", "record", "contig_id").agg(pieces.alias("seq")).collect())


def test_batch(spark, tmp_path):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    (tmp_path / "in").mkdir()
    one = ">long x\n" + "\n".join(letters(60) for _ in range(400)) + "\n>short\nAC\n"
    two = ">long y\n" + letters(30_000) + "\n>none\n"
    (tmp_path / "in" / "one.fa").write_text(one)
    (tmp_path / "in" / "two.fa").write_text(two)
    (tmp_path / "in" / "three.fa.gz").write_bytes(gzip.compress(one.encode()))
    (tmp_path / "in" / "_hidden").write_text(">no\nA\n")
    (tmp_path / "in" / "empty.fa").write_text("")
    df = fasta.fasta(spark, str(tmp_path / "in"), piece=500, range=4000)
    assert df.rdd.getNumPartitions() > 12
    assert whole(df) == sorted(plain(one.encode()) * 2 + plain(two.encode()))
    assert whole(fasta.fasta(spark, str(tmp_path / "in"))) == whole(df)
    text = genomic.read_fasta(spark, str(tmp_path / "in" / "two.fa")).withColumn("file", F.lit(""))
    assert whole(text) == whole(fasta.fasta(spark, str(tmp_path / "in" / "two.fa")))
    assert {r.source for r in fasta.fasta(spark, str(tmp_path / "in"), source="s").collect()} == {"s"}
    (tmp_path / "none").mkdir()
    assert fasta.fasta(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no scheme"):
        spark.read.format("fasta").load(str(tmp_path / "in")).count()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = fasta.fasta_stream(spark, str(tmp_path / "in"), str(tmp_path / "log"), piece=4)

    def run():
        df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return whole(spark.read.schema(fasta.SCHEMA).parquet(str(tmp_path / "out")))

    (tmp_path / "in" / "b.fa").write_text(">a\nACGTACGT\n>e\n")
    assert run() == [("a", "ACGTACGT"), ("e", "")]
    (tmp_path / "in" / "a.fa").write_text(">a\nTT\n")  # a name before those seen, and an id of another file
    assert run() == [("a", "ACGTACGT"), ("a", "TT"), ("e", "")]
    assert run() == [("a", "ACGTACGT"), ("a", "TT"), ("e", "")]
