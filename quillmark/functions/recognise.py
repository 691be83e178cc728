"""A recogniser (names and numbers of people, a scanner of secrets) as a layer of every write, failing closed.

A recogniser looks at batches of texts inside the tasks. Whatever goes wrong with it (it isn't there, dies, answers for
other texts than it was asked about, or with anything but findings) is a RecogniserUnavailable: the write fails before
anything is stored, and rows are never blamed for it.
"""

from __future__ import annotations

import json
import selectors
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillmark.functions.redact import redact_entities

# Entity types that count, and the least score of a finding.
ENTITIES = (
    "CREDIT_CARD", "CRYPTO", "EMAIL_ADDRESS", "IBAN_CODE", "IP_ADDRESS", "MEDICAL_LICENSE", "PHONE_NUMBER", "US_BANK_NUMBER",
    "US_DRIVER_LICENSE", "US_ITIN", "US_PASSPORT", "US_SSN",
)
THRESHOLD = 0.4
WAIT_SECONDS = 300.0


class RecogniserUnavailable(RuntimeError):
    """No text may pass: the recogniser didn't look at it."""


@dataclass(frozen=True)
class Recogniser:
    """find gets texts and gives (from, to, entity, score) of each finding in each of them; entities and threshold choose."""

    find: Callable[[list[str]], list[list[tuple[int, int, str, float]]]]
    entities: tuple[str, ...] = ENTITIES
    threshold: float = THRESHOLD

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        try:
            found = self.find(texts)
            if len(found) != len(texts):
                raise RecogniserUnavailable(f"the recogniser answered for {len(found)} of {len(texts)} texts")
            out = []
            for text, own in zip(texts, found, strict=True):
                for a, b, entity, score in own:
                    if not (isinstance(a, int) and isinstance(b, int) and 0 <= a < b <= len(text) and isinstance(entity, str) and isinstance(score, (int, float))):
                        raise RecogniserUnavailable(f"the recogniser gave no finding: {(a, b, entity, score)!r}")
                out.append([(a, b, entity.lower()) for a, b, entity, score in own if score >= self.threshold and entity in self.entities])
            return out
        except RecogniserUnavailable:
            raise
        except Exception as e:
            raise RecogniserUnavailable(f"RecogniserUnavailable: {type(e).__name__}: {e}") from e

    def over(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        have = [c for c in columns if c in df.columns]
        return redact_entities(df, have, self.spans) if have else df


#: A worker's running commands, which live on from batch to batch.
_RUNNING: dict[tuple[str, ...], subprocess.Popen] = {}


def command(args: Sequence[str], wait: float = WAIT_SECONDS) -> Callable[[list[str]], list[list[tuple[int, int, str, float]]]]:
    """find by a program that each worker starts once: a line {"texts": [..]} in, a line {"found": [[[from, to, entity, score], ..], ..]} out."""
    key = tuple(args)

    def ask(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        running = _RUNNING.get(key)
        if running is None or running.poll() is not None:
            running = _RUNNING[key] = subprocess.Popen(key, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            running.stdin.write(json.dumps({"texts": texts}).encode() + b"\n")
            running.stdin.flush()
            with selectors.DefaultSelector() as ready:
                ready.register(running.stdout, selectors.EVENT_READ)
                line = running.stdout.readline() if ready.select(wait) else b""
            return [[tuple(x) for x in own] for own in json.loads(line)["found"]]
        except Exception:
            _RUNNING.pop(key).kill()
            raise

    return ask
