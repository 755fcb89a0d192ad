"""The threshold of op3 comes from trusted texts the model never saw, and no odd one sets it."""

import random
import zlib

import pytest

from melodyspark.llm import quality


@pytest.mark.parametrize("seen", [True, False])
def test_one_odd_trusted_text_lets_no_junk_pass(spark, seen):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(40))
    junk = lambda: "".join(rnd.choice("qxzjkvwyghpbfm.,!0") for _ in range(200))
    odd = next(i for i in range(1000) if (zlib.crc32(str(i).encode()) % 5 != 0) == seen)
    rows = [(i, junk() if i == odd else prose(), "en") for i in range(190)] + [(1000 + i, junk(), "en") for i in range(20)] + [(2000 + i, prose(), "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(190)], "doc_id long, quality int")
    # with 38 held-out texts the quantile 0.95 is below their largest
    got = {r["doc_id"]: r["kept"] for r in quality.perplexity_report(docs, labels, **({} if seen else {"quantile": 0.95})).collect()}
    assert not any(got[1000 + i] for i in range(20))
    assert sum(got[2000 + i] for i in range(50)) >= 40
