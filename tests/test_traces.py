"""Traces as JSON lines and as Markdown, on two small traces."""

import json

from pyspark.sql import functions as F

from screenlake.operators import traces


def attempt(tier, messages, response=None, usage=(0, 0), usd=None, invalid=None, error=None):
    return {"tier": tier, "messages": [{"role": r, "content": c} for r, c in messages], "raw_response": response, "usage": dict(zip(("prompt_tokens", "completion_tokens"), usage, strict=True)), "usd": usd, "validation_error": invalid, "error": error}


def step(trace, n, agent="compiler", attempts=(), parsed=None, skipped=()):
    return {"trace": trace, "step": n, "timestamp": "2026-01-01T00:00:00Z", "agent": agent, "provider": "p", "model": "m", "system_prompt": "Be brief.", "user_prompt": f"ask {n}", "attempts": list(attempts), "skipped_tiers": [list(x) for x in skipped], "parsed": parsed}


ASK = [("system", "Be brief."), ("user", "ask 1")]
STEPS = [
    step("b", 1, "critic", [attempt("json", [], error="429")]),
    step("a", 2, "critic", [attempt("json", ASK, "ok ```x```", (5, 1), None)], ["one", {"two": 2}]),
    step("a", 1, attempts=[attempt("json", ASK, "{", (10, 2), 0.5, invalid="not JSON"), attempt("json", [*ASK, ("user", "again")], '{"v":"é"}', (20, 3), 0.25)], parsed={"v": "é"}, skipped=[("tools", "no tools here")]),
]
GOLDEN_A = """# Trajectory

**Calls:** 2 | **Prompt tokens:** 35 | **Completion tokens:** 6 | **Estimated cost:** $0.7500

| # | Agent | Model | Tier | Retries | Tokens | Cost | Outcome |
|---|---|---|---|---:|---:|---:|---|
| 1 | compiler | p/m | `json` | 1 | 35 | $0.7500 | validated |
| 2 | critic | p/m | `json` | 0 | 6 | unpriced | validated |

## 1. compiler on p/m

- **Started:** 2026-01-01T00:00:00Z
- **Tier used:** `json`
- **Retries:** 1
- **Tokens:** 30 in / 5 out
- **Estimated cost:** $0.7500
- **Outcome:** validated

### Instructions

```
Be brief.
```

### Request

```
ask 1
```

### Tier `tools` not attempted

no tools here

### Attempt 1, tier `json`

Response:

```
{
```

The response did not validate:

```
not JSON
```

### Attempt 2, tier `json`

Sent back to the model:

```
[user]
again
```

Response:

```
{"v":"é"}
```

Validated against the schema.

### Result

```json
{"v":"é"}
```

## 2. critic on p/m

- **Started:** 2026-01-01T00:00:00Z
- **Tier used:** `json`
- **Retries:** 0
- **Tokens:** 5 in / 1 out
- **Estimated cost:** unpriced
- **Outcome:** validated

### Instructions

```
Be brief.
```

### Request

```
ask 2
```

### Attempt 1, tier `json`

Response:

````
ok ```x```
````

Validated against the schema.

### Result

```json
["one",{"two":2}]
```

## Cost

| Agent | Calls | Prompt | Completion | Cost |
|---|---:|---:|---:|---:|
| compiler | 1 | 30 | 5 | $0.7500 |
| critic | 1 | 5 | 1 | unpriced |

| Model | Calls | Prompt | Completion | Cost |
|---|---:|---:|---:|---:|
| m | 2 | 35 | 6 | $0.7500 |
"""


def read_back(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(s, ensure_ascii=False) for s in STEPS) + "\n\n")
    return traces.read(spark, str(tmp_path / "in.jsonl"))


def test_json_lines_there_and_back(spark, tmp_path):
    steps = read_back(spark, tmp_path)
    traces.write(steps, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x["trace"], x["step"]) for x in lines] == [("a", 1), ("a", 2), ("b", 1)]
    assert [{k: x[k] for k in traces.FIELDS} for x in lines] == sorted(STEPS, key=lambda s: (s["trace"], s["step"]))
    assert [(x["tier"], x["retries"], x["validated"], x["usd"], x["validation_errors"]) for x in lines] == [("json", 1, True, 0.75, ["not JSON"]), ("json", 0, True, None, []), ("json", 0, False, None, [])]
    again = traces.read(spark, str(tmp_path / "out"))
    assert sorted(r.j for r in again.select(F.to_json("parsed").alias("j")).filter("j <> 'null'").collect()) == ['["one",{"two":2}]', '{"v":"é"}']


def test_markdown_of_two_traces(spark, tmp_path):
    traces.write_markdown(read_back(spark, tmp_path), str(tmp_path / "md"))
    text = lambda t: "".join(f.read_text() for f in sorted((tmp_path / "md" / f"trace={t}").glob("part-*")))
    assert text("a") == GOLDEN_A
    b = text("b")
    assert "**Estimated cost:** unpriced" in b and "- **Outcome:** no valid response" in b and "The provider rejected the request:\n\n```\n429\n```" in b and "Validated against" not in b and "### Result" not in b
