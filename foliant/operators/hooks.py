"""External models over pages: a subprocess for each partition that speaks JSON lines.

A hook first writes a handshake with its capabilities, which fix its phase (ocr, layout,
annotate; the earliest wins), then answers a request for each page. A reply must come within
the timeout; three invalid replies in a row end the hook for its partition, and its pages come
back without answers. Hooks run commands, so they are off unless ``allow`` is given.
"""

from __future__ import annotations

import json
import queue
import re
import subprocess
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import n_words

#: Phases in their order, the protocol's name, and limits. Fixed values.
PHASES = ["ocr", "layout", "annotate"]
PROTOCOL = "hook"
MAX_FAILURES = 3
MAX_ITEMS = 10_000
MAX_KEY = 256
OCR_WORDS = 10

REPLY = "struct<spans:array<struct<text:string,x:double,y:double,width:double,height:double>>,regions:array<struct<kind:string,x:double,y:double,width:double,height:double>>,blocks:array<struct<kind:string,level:int,text:string>>,overlays:map<string,string>,labels:map<string,string>,entities:array<struct<type:string,text:string>>>"


@dataclass
class Hook:
    command: list[str]
    timeout: float = 60.0
    needs: list[str] = field(default_factory=lambda: ["text"])


def valid_key(key: str) -> bool:
    """Keys of overlays and labels: letters, digits, dot, dash, underline, up to 256."""
    return 0 < len(key) <= MAX_KEY and re.fullmatch(r"[A-Za-z0-9._-]+", key) is not None


def phase_of(capabilities: list[str]) -> str | None:
    return next((p for p in PHASES if p in capabilities), None)


def parse_handshake(line: str) -> tuple[str, dict]:
    """('valid', handshake), ('wrong_protocol', …) or ('none', {}) if the line is no handshake."""
    try:
        value = json.loads(line)
    except ValueError:
        return "none", {}
    if not isinstance(value, dict) or "protocol" not in value:
        return "none", {}
    if value["protocol"] != PROTOCOL or phase_of(value.get("capabilities", [])) is None:
        return "wrong_protocol", value
    return "valid", value


class Process:
    """A running hook; lines are read by a thread so that a reply can time out."""

    def __init__(self, hook: Hook):
        self.hook, self.failures, self.dead = hook, 0, False
        self.run = subprocess.Popen(hook.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, bufsize=1)
        self.lines: queue.Queue[str | None] = queue.Queue()
        threading.Thread(target=self._read, daemon=True).start()
        first = self._line()
        self.kind, self.handshake = parse_handshake(first or "")
        self.dead = self.kind != "valid"
        self.phase = phase_of(self.handshake.get("capabilities", [])) if not self.dead else None

    def _read(self) -> None:
        for line in self.run.stdout:
            self.lines.put(line)
        self.lines.put(None)

    def _line(self) -> str | None:
        try:
            return self.lines.get(timeout=self.hook.timeout)
        except queue.Empty:
            return None

    def ask(self, request: dict) -> str | None:
        """The reply's JSON text, or None; a timeout ends the hook, as later replies would be out of step."""
        if self.dead:
            return None
        try:
            self.run.stdin.write(json.dumps(request, ensure_ascii=False) + "\n")
            line = self._line()
        except (BrokenPipeError, OSError):
            line = None
        if line is None:
            self.close()
            return None
        try:
            value = json.loads(line)
            if isinstance(value, dict) and not value.get("error"):
                self.failures = 0
                return line
        except ValueError:
            pass
        self.failures += 1
        if self.failures >= MAX_FAILURES:
            self.close()
        return None

    def close(self) -> None:
        self.dead = True
        self.run.kill()
        self.run.wait()


def run_hook(pages: DataFrame, hook: Hook, allow: bool = False) -> DataFrame:
    """(doc_id, page, text) -> the same with ``reply`` (JSON text or null): one process for each partition."""
    if not allow:
        raise PermissionError("hooks run commands; pass allow=True to permit it")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = Process(hook)
        try:
            for frame in frames:
                replies = [process.ask({"doc_id": int(d), "page": int(p)} | ({"text": t} if "text" in hook.needs else {})) for d, p, t in zip(frame["doc_id"], frame["page"], frame["text"], strict=True)]
                yield frame.assign(reply=replies)
        finally:
            process.close()

    return pages.select("doc_id", "page", "text").mapInPandas(run, "doc_id long, page int, text string, reply string")


def ocr_pages(pages: DataFrame, forced: bool = False) -> DataFrame:
    """Pages that go to an OCR hook: those with fewer than ten words, or all if forced."""
    return pages if forced else pages.where(n_words(F.col("text")) < OCR_WORDS)


def parsed(replies: DataFrame) -> DataFrame:
    return replies.withColumn("r", F.from_json("reply", REPLY))


def reply_spans(replies: DataFrame, page_height: float | None = None) -> DataFrame:
    """Spans of replies, up to the limit for a page; y goes from top-down to bottom-up if the height is given."""
    rows = parsed(replies).select("doc_id", "page", F.posexplode(F.slice("r.spans", 1, MAX_ITEMS)).alias("span_idx", "s"))
    y = F.col("s.y") if page_height is None else F.lit(page_height) - F.col("s.y") - F.col("s.height")
    return rows.select("doc_id", "page", "span_idx", "s.text", "s.x", y.alias("y"), "s.width", F.col("s.height").alias("font_size"))


def reply_blocks(replies: DataFrame) -> DataFrame:
    rows = parsed(replies).select("doc_id", "page", F.posexplode(F.slice("r.blocks", 1, MAX_ITEMS)).alias("ord", "b"))
    return rows.select("doc_id", "page", "ord", "b.*")


def reply_properties(replies: DataFrame) -> DataFrame:
    """Overlays and labels of replies as (doc_id, page, key, value) with prefixed, valid keys."""
    r = parsed(replies)
    both = F.map_concat(
        F.coalesce(F.transform_keys("r.overlays", lambda k, v: F.concat(F.lit("overlay."), k)), F.create_map().cast("map<string,string>")),
        F.coalesce(F.transform_keys("r.labels", lambda k, v: F.concat(F.lit("label."), k)), F.create_map().cast("map<string,string>")),
    )
    rows = r.select("doc_id", "page", F.explode(both).alias("key", "value"))
    bare = F.regexp_replace("key", "^(overlay|label)\\.", "")
    return rows.where(bare.rlike("^[A-Za-z0-9._-]{1,256}$"))


def document_replies(replies: DataFrame) -> DataFrame:
    """A whole document's reply {"pages": [...]} as one reply row for each page."""
    pages = F.from_json("reply", "struct<pages:array<string>>")["pages"]
    return replies.select("doc_id", F.posexplode(pages).alias("page", "reply"))


def block_lines(replies: DataFrame) -> DataFrame:
    """Blocks of a cloud OCR reply that lists LINE blocks with relative boxes."""
    schema = "struct<Blocks:array<struct<BlockType:string,Text:string,Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>>>>"
    rows = replies.select("doc_id", F.posexplode(F.from_json("reply", schema)["Blocks"]).alias("ord", "b")).where("b.BlockType = 'LINE'")
    box = F.col("b.Geometry.BoundingBox")
    return rows.select("doc_id", "ord", F.col("b.Text").alias("text"), F.col("b.Confidence").alias("confidence"), box["Left"].alias("x"), box["Top"].alias("y"), box["Width"].alias("width"), box["Height"].alias("height"))
