"""The strict reading of payloads, against Python's."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions.records import strict_json

WHOLE = '{"id":"a\\"b","type":"credit","body":{"n":[1,{"x":null}],"reason":null,"ok":true,"t":"\\u00e9é"},"timestamp":1465171202365}'


def refuse(_):
    raise ValueError


def test_equals_python(spark):
    rng = random.Random(4)
    texts = [WHOLE[:i] for i in range(len(WHOLE) + 1)] + [WHOLE + x for x in ("}", "]", " ", "x", ",1", ',"a":1}', "\n", "{}")] + [x + WHOLE for x in ("[", " ", "x", '"')]
    texts += [WHOLE + x for x in (',"x":{"timestamp":2}', '],"w":[' + WHOLE, "],[" + WHOLE, "],[", ",{}", "," + WHOLE)]
    texts += ["[]", "null", '"{\'timestamp\':1', "{'timestamp':1}", '{"timestamp":"1"}', '{"timestamp":1.5e3}', '{"timestamp":true}', '{"timestamp":NaN}', '{"timestamp":"NaN"}', '{"timestamp":null}', '{"timestamp":[1]}', '{"timestamp":1,}', '{"timestamp":01}', "[" + WHOLE + "]", '{"a":"\t","timestamp":1}', '{"timestamp":-5}']
    for _ in range(400):
        i = rng.randrange(len(WHOLE))
        texts.append(WHOLE[:i] + rng.choice('{}[]",:x0 \\n') + WHOLE[i + rng.randrange(2) :])
    df = spark.createDataFrame([(t.encode(),) for t in texts], "v binary").select(strict_json(F.col("v"), "timestamp double, type string")["timestamp"].alias("t"))
    for text, r in zip(texts, df.collect(), strict=True):
        try:
            o = json.loads(text, parse_constant=refuse)
            t = o.get("timestamp") if isinstance(o, dict) else None
            want = float(t) if isinstance(t, (int, float)) and not isinstance(t, bool) else None
        except ValueError:
            want = None
        assert r["t"] == want, text
