import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quern.llm.token_files import ShardReader, read_token_files, write_token_files

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip_in_order_of_ids(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 37 % 101, f"Text number {i}, with words. " * (i % 5), "x") for i in range(101)]
    rows += [(7, "a second row of id seven", None), (7, "a second row of id seven", None), (None, "no id", None), (-5, None, None), (300, "long text " * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    folder, manifest = write_token_files(df, PATH, f"file://{tmp_path}/out")
    got = read_token_files(spark, folder, manifest).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at
        ids = next(x for x in want[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        want[r.doc_id].remove(ids)
        assert r.n_tokens == len(ids)
        at += len(ids)
    back = [list(map(int, x)) for s in manifest for _, _, x in ShardReader(folder, s.name, s.width).documents()]
    assert sum(map(len, back)) == at and manifest[0].width == 2


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder, manifest = write_token_files(df, PATH, f"file://{tmp_path}/none")
    assert manifest == [] and read_token_files(spark, folder, manifest).count() == 0
