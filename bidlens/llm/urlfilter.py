"""URL filters by a bit-parallel wildcard automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: (verdict, rule); a rule is a host, a slash and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def compile_globs(globs: list[str]):
    """Shift-And masks of all globs side by side in 64-bit words.

    In a glob `*` is any run without a slash and `**` any run. A literal byte takes one bit; a star
    marks the bit before it as one that stays on while the run lasts. Returns per-byte masks of the
    bits that the byte may enter and of those that it may stay in, the entry bits (with the ones that
    a leading star keeps alive) and each glob's last bit.
    """
    bits = []  # (byte or None for a glob's start, stays on any byte, stays on bytes but slash)
    last = []
    for g in globs:
        bits.append([None, False, False])
        i = 0
        raw = g.encode()
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                bits[-1][1] = True
                i += 2
            elif raw[i : i + 1] == b"*":
                bits[-1][2] = True
                i += 1
            else:
                bits.append([raw[i], False, False])
                i += 1
        last.append(len(bits) - 1)
    n = max(1, -(-len(bits) // 64))
    enter, stay, start = np.zeros((256, n), np.uint64), np.zeros((256, n), np.uint64), np.zeros(n, np.uint64)
    for i, (byte, anything, segment) in enumerate(bits):
        w, bit = i // 64, U64(1) << U64(i % 64)
        if byte is None:
            start[w] |= bit
        else:
            enter[byte, w] |= bit
        if anything or segment:
            stay[:, w] |= bit
            if not anything:
                stay[ord("/"), w] &= ~bit
    return enter, stay, start, last


def simulate(texts: list[bytes], compiled) -> np.ndarray:
    """Row per text, column per glob: whether the glob fits the whole text. All texts step together,
    the shorter ones leaving as they end, so the work is the texts' bytes times the mask's words."""
    enter, stay, start, last = compiled
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    state = np.repeat(start[None, :], len(texts), 0)
    if len(texts) and size.max(initial=0):
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.r_[0, np.cumsum(size)[:-1]][order]
        left = size[order]
        alive = len(texts)
        for j in range(int(left[0])):
            while alive and left[alive - 1] <= j:
                alive -= 1
            byte = flat[begin[:alive] + j]
            now = state[:alive]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            state[:alive] = (moved & enter[byte]) | (now & stay[byte])
    out = np.zeros((len(texts), len(last)), bool)
    for g, bit in enumerate(last):
        out[order, g] = (state[:, bit // 64] >> U64(bit % 64)) & U64(1) != 0
    return out


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    Host and path are native expressions; a null url or one without `://` has both empty. The longest
    fitting rule wins (of equal ones the first listed); without one the rule is null and the verdict
    the default. A row with a null page_id is judged like any other. No shuffle: a hot host costs
    nothing extra. The rule set is a parameter and travels with the task.
    """
    ranked = sorted(enumerate(rules), key=lambda x: (-len(x[1][1]), x[0]))
    globs = [f"*.{r.split('/', 1)[0]}/{r.split('/', 1)[1]}**" for _, (_, r) in ranked]
    names = [r for _, (_, r) in ranked]
    verdicts = [v for _, (v, _) in ranked]
    compiled = compile_globs(globs)
    rest = F.expr("substring(url, locate('://', url) + 3)")
    rest = F.when(F.col("url").contains("://"), rest).otherwise("")
    parts = pages.select("page_id", rest.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )

    def judge(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                fits = simulate([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)], compiled)
                best = np.where(fits.any(1), fits.argmax(1), -1) if fits.shape[1] else np.full(len(hosts), -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([names[i] if i >= 0 else None for i in best], pa.string()), pa.array([verdicts[i] if i >= 0 else default for i in best], pa.string())],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def op5_url_filters(spark, sf_dir) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, CASE
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM q
"""
