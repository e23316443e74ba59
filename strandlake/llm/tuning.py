"""Choice of op4's settings by cross-validation inside the rows that may teach it.

    python -m strandlake.llm.tuning SF_DIR

Folds are numbers of crc32(doc_id) / 3, of rows whose remainder by 3 is not 1: no held-out row is read. Each text is
scored twice, as it is and with a letter put into each word of 4 letters or more, toxic or not. Of the settings by
which TOLERANT of landmarks' spellings with one letter more are caught, the best has the highest F1 of `predicted` over
both and all folds together, to two places, then the largest area under the curve, then catches most of such spellings.
"""

from __future__ import annotations

import itertools
import os
import random
import re
import sys
import zlib
from bisect import bisect_left, bisect_right
from concurrent.futures import ProcessPoolExecutor

import numpy as np

from . import toxicity

FOLDS = 3
TOLERANT = 0.9
GRID = {"DECAY": (0.6, 0.7, 0.8, 0.9), "LEAST": (0.2, 0.3, 0.4), "CROWD": (2, 4, 8)}


def _fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) // 3 % FOLDS


def altered(text: str, seed: int) -> str:
    """text with a letter at a random place inside each word of 4 letters or more."""
    rng = random.Random(seed)

    def put(found: re.Match) -> str:
        word = found.group()
        at = rng.randrange(1, len(word))
        return word[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[at:]

    return re.sub(r"[^\W\d_]{4,}", put, text)


def _scores(model: toxicity.Model, texts: list[bytes]) -> np.ndarray:
    return model.scores(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def _rated(rows: list[tuple[int, str, int]], setting: dict, fold: int) -> tuple[list[tuple[int, float]], list[bool]]:
    """(label, score) of one fold's rows by a model of the others; and which spellings of its landmarks are caught."""
    for name, value in setting.items():
        setattr(toxicity, name, value)
    toxic, clean = ([t for d, t, y in rows if _fold(d) != fold and (y == 1) == want] for want in (True, False))
    model = toxicity.fit(toxic, clean)
    mine = [(y, form.encode()) for d, t, y in rows if _fold(d) == fold for form in (t, altered(t, d))]
    found = [(int(y == 1), float(s)) for (y, _), s in zip(mine, _scores(model, [raw for _, raw in mine]))]
    spelled = [z[:i] + c + z[i:] for z in model.landmarks if z.isascii() for i in range(1, len(z)) for c in (b"q", b"x", b"e")]
    return found, (_scores(model, spelled) >= toxicity.EDGE).tolist() if spelled else []


def figures(found: list[tuple[int, float]], border: float) -> tuple[float, float, float, float]:
    """F1, precision, recall and area under the curve of (label, score); ties count half."""
    hits = sum(1 for y, s in found if y and s >= border)
    alarms = sum(1 for y, s in found if not y and s >= border)
    toxic = sum(y for y, _ in found)
    above = sorted(s for y, s in found if not y)
    area = sum(bisect_left(above, s) + bisect_right(above, s) for y, s in found if y)
    return (2 * hits / max(1, hits + alarms + toxic), hits / max(1, hits + alarms), hits / max(1, toxic), area / max(1, 2 * toxic * len(above)))


def compare(rows: list[tuple[int, str, int]], grid: dict = GRID, workers: int | None = None) -> list[tuple]:
    """(figures, setting) of every setting of the grid, best first. rows is the bounded sample of toxicity.labelled."""
    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    jobs = [(k, fold) for k in range(len(settings)) for fold in range(FOLDS)]
    with ProcessPoolExecutor(workers or os.cpu_count()) as pool:
        parts = list(pool.map(_rated, itertools.repeat(rows), [settings[k] for k, _ in jobs], [fold for _, fold in jobs]))
    pooled: list[list[tuple[int, float]]] = [[] for _ in settings]
    caught: list[list[bool]] = [[] for _ in settings]
    for (k, _), (found, spelled) in zip(jobs, parts):
        pooled[k] += found
        caught[k] += spelled
    rated = [((*figures(p, toxicity.EDGE), sum(c) / max(1, len(c))), s) for p, c, s in zip(pooled, caught, settings)]
    return sorted(rated, key=lambda r: (r[0][4] < TOLERANT, -round(r[0][0], 2), -round(r[0][3], 3), -r[0][4]))


def main(sf_dir: str) -> None:
    from ..session import local_session

    spark = local_session()
    rows = [(r.doc_id, r.text, r.toxic) for r in toxicity.labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))]
    spark.stop()
    print(len(rows), "rows,", sum(y == 1 for _, _, y in rows), "toxic")
    for (f1, precision, recall, area, spelled), setting in compare(rows):
        print(f"F1 {f1:.3f} precision {precision:.3f} recall {recall:.3f} AUC {area:.3f} spellings {spelled:.2f}", setting)


if __name__ == "__main__":
    main(*sys.argv[1:])
