import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, docs
from turnstile.llm import langid


def test_limits_follow_from_every_labelled_text(spark):
    """Over a thousand texts a half, and copies: the percentile of all different ones, each measured by the other half."""
    rnd = random.Random(3)
    words = PROSE.split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(4, 30))) + f" {'xyz'[k % 3] * (k % 40)}"
             for k in range(2600)]
    labelled = docs(spark, [*enumerate(texts), (-1, None), (-2, "…", "en"), (-3, "no label", None)]) \
        .unionByName(docs(spark, [(k, texts[0]) for k in range(300)])).repartition(3)
    got = langid.learn_limits(langid.train(labelled), labelled).limits
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2))
    different = labelled.where("lang = 'en' and text is not null and text <> '…'").dropDuplicates(["text"])
    entropies = []
    for k in range(2):
        parser = langid.train(labelled.where(half == 1 - k))
        normal = [langid.normalise(r["text"])[0] for r in different.where(half == k).collect()]
        entropies += [float(langid.sure_entropy(row, parser.weight, len(codes))[0])
                      for row, codes in zip(parser.phrases(normal), normal)]
    assert len(entropies) == len(set(texts)) > 2500
    want = langid.CLEARLY * np.quantile(entropies, langid.LIMIT_SHARE)
    assert abs(got["en"] - want) < 1e-9
