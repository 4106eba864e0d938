"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _row(**fields: str | T.DataType) -> T.StructType:
    out = T.StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out


#: A read: the fixed columns of the signal container; declared auxiliary columns follow them.
READ = _row(read_id="string", read_group="long", digitisation="double", offset="double", range="double", sampling_rate="double", len_raw_signal="long", raw_signal=T.ArrayType(T.ShortType()))
#: An undecoded record of a container: the stored bytes of a binary one, the line of a text one.
RAW_RECORD = _row(read_id="string", record="binary")
#: Header attributes, one row for each file and read group.
READ_GROUP = _row(path="string", read_group="long", attrs=T.MapType(T.StringType(), T.StringType()))
#: Where a record lies in a container.
RECORD_INDEX = _row(path="string", read_id="string", offset="long", size="long")
EVENT = _row(start="long", length="float", mean="float", stdv="float")
SEGMENT = _row(x="long", y="long")
KMER_MODEL = _row(rank="integer", kmer="string", level_mean="float", level_stdv="float")
CONTIG = _row(ref_idx="integer", name="string", comment="string", seq="string")
#: One row for each strand of a contig; levels are z-scored.
REFERENCE = _row(ref_idx="integer", name="string", ref_len="integer", seq_len="integer", st_offset="integer", strand="string", levels=T.ArrayType(T.FloatType()))
PAF = _row(
    rid="string", qlen="integer", query_start="integer", query_end="integer", strand="string", tid="string", tlen="integer", target_start="integer", target_end="integer", n_residue="integer", block_len="integer", mapq="integer", tp="string", d1="float", d2="float"
)
REGION = _row(ref="string", beg="long", end="long")
