"""Text files as items in walk order, and files read through external programs where they are installed."""

from __future__ import annotations

import json
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.items import make_items
from .payloads import parse_rows, video

TEXT = ("txt", "md", "rst", "markdown", "text")


def _walk_key(path, root: str):
    """Orders as a top-down walk does: a folder's files by name, then its folders by name."""
    parts = F.split(F.substring(path, F.length(F.lit(root)) + 1, F.length(path)), "/")
    n = F.size(parts)
    return F.transform(parts, lambda p, i: F.concat(F.when(i < n - 1, F.lit("1")).otherwise(F.lit("0")), p))


def text_files(spark: SparkSession, path: str, fetched_at: float) -> DataFrame:
    """Items (document, file-read) of a file of any kind, or of a folder's text files; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bare = F.regexp_replace("path", "^file:/+", "/")
    ext = F.lower(F.substring_index(F.col("path"), ".", -1))
    root = path.rstrip("/")
    files = files.withColumn("p", bare).where(ext.isin(*TEXT) | (F.col("p") == root))
    text = F.decode("content", "UTF-8")
    name = F.substring_index(F.col("p"), "/", -1)
    return make_items(files.withColumn("walk", _walk_key(F.col("p"), root)), keep=("walk",), kind=F.lit("document"), id=F.col("p"), title=name, text=text, source=F.lit("docs"), ref=F.col("p"), method=F.lit("file-read"), fetched_at=fetched_at)


# What each program is called with, and the item that its output becomes.
PROGRAMS: dict[str, tuple[str, Callable[[str, str], list[str]], str, str]] = {
    "pdf": ("pdftotext", lambda f, out: ["pdftotext", "-q", "-enc", "UTF-8", "--", f, "-"], "paper", "pdftotext"),
    "ocr": ("tesseract", lambda f, out: ["tesseract", f, "stdout", "-l", "eng"], "document", "ocr"),
    "transcribe": ("whisper", lambda f, out: ["whisper", f, "--output_format", "txt", "--output_dir", out], "transcript", "transcribe"),
    "browser": ("chromium", lambda f, out: ["chromium", "--headless", "--disable-gpu", "--dump-dom", f], "webpage", "browser-extract"),
    "video": ("yt-dlp", lambda f, out: ["yt-dlp", "--dump-single-json", "--skip-download", "--", f], "metadata", "yt-dlp"),
}


def available(program: str) -> bool:
    return shutil.which(PROGRAMS[program][0]) is not None


def external_text(targets: DataFrame, program: str, column: str = "target", timeout: float = 300.0, run: Callable | None = None) -> DataFrame:
    """(target, text, error) of each target through a program; a missing program is an error row, not a failed job."""
    call = run or subprocess.run
    name, command, _, _ = PROGRAMS[program]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for t in pdf[column]:
                with tempfile.TemporaryDirectory() as folder:
                    try:
                        done = call(command(t, folder), capture_output=True, timeout=timeout, check=True)
                        texts = sorted(Path(folder).glob("*.txt"))
                        out.append((t, texts[0].read_text("utf-8", "replace") if texts else done.stdout.decode("utf-8", "replace"), None))
                    except (OSError, subprocess.SubprocessError) as e:
                        out.append((t, None, f"{name}: {str(e)[:160]}"))
            yield pd.DataFrame(out, columns=["target", "text", "error"])

    return targets.select(column).mapInPandas(each, "target string, text string, error string")


def external_items(texts: DataFrame, program: str, fetched_at: float) -> DataFrame:
    _, _, kind, method = PROGRAMS[program]
    good = texts.where("error IS NULL")
    return make_items(good, kind=F.lit(kind), id=F.col("target"), title=F.substring_index("target", "/", -1), text=F.col("text"), source=F.lit(program), ref=F.col("target"), method=F.lit(method), fetched_at=fetched_at)


def video_payloads(targets: DataFrame, column: str = "target", comments: bool = False, timeout: float = 120.0, run: Callable | None = None) -> DataFrame:
    """(target, payload, caption_error, error) of each video: its information and captions as one JSON payload.

    Captions that people made are asked for first, those of a machine only where there are none; the payload tells which.
    Captions that could not be asked for are told in caption_error, and the video's other rows are still made.
    """
    call, name = run or subprocess.run, PROGRAMS["video"][0]

    def ask(args: list[str]):
        return call([name, "--skip-download", *args], capture_output=True, timeout=timeout)

    def captions(target: str, auto: bool) -> tuple[str | None, str | None]:
        flag = "--write-auto-subs" if auto else "--write-subs"
        with tempfile.TemporaryDirectory() as folder:
            try:
                done = ask([flag, "--sub-langs", "en.*", "--sub-format", "vtt", "-o", f"{folder}/%(id)s.%(ext)s", "--", target])
            except (OSError, subprocess.SubprocessError) as e:
                return None, f"{flag}: {str(e)[:160]}"
            texts = sorted(Path(folder).glob("*.vtt"))
            if texts:
                return texts[0].read_text("utf-8", "replace"), None
            return None, f"{flag}: {done.stderr.decode('utf-8', 'replace').strip()[:160]}" if done.returncode else None

    def one(target: str) -> tuple:
        try:
            info = ask(["--dump-single-json", *(["--write-comments"] if comments else []), "--", target])
        except (OSError, subprocess.SubprocessError) as e:
            return target, None, None, f"{name}: {str(e)[:160]}"
        if info.returncode:
            return target, None, None, f"{name}: {info.stderr.decode('utf-8', 'replace').strip()[:160]}"
        failed = []
        for auto in (False, True):
            vtt, error = captions(target, auto)
            failed += [error] if error else []
            if vtt is not None:
                break
        payload = {"info": info.stdout.decode("utf-8", "replace"), "vtt": vtt, "auto": auto}
        return target, json.dumps(payload), "; ".join(failed) or None, None

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([one(t) for t in pdf[column]], columns=["target", "payload", "caption_error", "error"])

    return targets.select(column).mapInPandas(each, "target string, payload string, caption_error string, error string")


def parse_video(payload: str, url: str) -> list[dict]:
    """Item rows of a payload of video_payloads; one may name its captions' method beside, which folds nothing."""
    p = json.loads(payload)
    return video(p["info"], p.get("vtt"), bool(p.get("auto")), transcript_method=p.get("transcript_method"))


def video_items(found: DataFrame, fetched_at: float) -> tuple[DataFrame, DataFrame]:
    """(items with url and pos, errors) of a table from video_payloads."""
    rows, bad = parse_rows(found.where("error IS NULL").select(F.col("target").alias("url"), "payload"), parse_video, fetched_at)
    return rows, bad.unionByName(found.where("error IS NOT NULL").select(F.col("target").alias("url"), "error"))
