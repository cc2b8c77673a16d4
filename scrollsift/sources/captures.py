"""Capture messages: landing-zone streams, decoding with a size guard, files, shell records."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D

MESSAGE = "type string, session_id string, timestamp bigint, command string, output string, exit_code int, cwd string"
RESPONSE = "success boolean, message string, data string"


def landing(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of raw messages, one JSON object a line; the files a trigger takes bound the queue."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def decoded(messages: DataFrame, most_bytes: int = D.MESSAGE_BYTES) -> DataFrame:
    """value -> message fields and ``reject``: too long, not JSON, or null if it is fine."""
    parsed = messages.withColumn("m", F.from_json("value", MESSAGE))
    reason = F.when(F.octet_length("value") > most_bytes, "oversize").when(F.col("m.type").isNull(), "malformed")
    return parsed.withColumn("reject", reason).select("value", "reject", "m.*")


def accepted(decoded: DataFrame) -> DataFrame:
    """Captures of well-formed messages."""
    good = decoded.filter("reject is null and type = 'capture'")
    return good.select("session_id", F.timestamp_seconds("timestamp").alias("ts"), "command", F.coalesce("output", F.lit("")).alias("output"), "exit_code", "cwd")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter("reject is not null").select("value", "reject")


def responses(results: DataFrame) -> DataFrame:
    """(success, message, data) -> value: JSON, absent fields left out."""
    return results.select(F.to_json(F.struct("success", "message", "data")).alias("value"))


def send(folder: str, messages: list[dict]) -> str:
    """Producer: put messages into a landing folder as one file, visible at once."""
    path = os.path.join(folder, f"{uuid.uuid4().hex}.json")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(m) + "\n" for m in messages)
    os.rename(path + ".tmp", path)
    return path


def output_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, output): whole files; what isn't UTF-8 counts as empty."""
    raw = spark.read.format("binaryFile").load(folder)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select("path", F.coalesce(text, F.lit("")).alias("output"))


def recorded(commands: DataFrame, own: str = "scrollsift") -> DataFrame:
    """Shell records without the engine's own commands and without empty ones."""
    return commands.filter((F.trim("command") != "") & ~F.col("command").rlike(rf"^\s*{own}\b"))


def stored_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, size, content) of a folder of sharded blob files; unfinished files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return raw.filter(~F.col("path").endswith(".tmp")).select(name.alias("hash"), F.col("length").alias("size"), "content")


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """State files of sessions; unreadable ones are skipped."""
    schema = "id string, name string, started_at timestamp, stopped_at timestamp, status string, capture_count bigint, blob_count bigint, metadata map<string,string>, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder)
    return rows.filter("_corrupt_record is null and id is not null").drop("_corrupt_record")


def save_session(folder: str, state: dict) -> str:
    """Write a session's state file, visible at once."""
    at = os.path.join(folder, "sessions", state["id"])
    os.makedirs(at, exist_ok=True)
    path = os.path.join(at, "state.json")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(state, f, indent=2)
    os.replace(path + ".tmp", path)
    return path


def delete_session(folder: str, session: str) -> None:
    """Delete a session's folder; an unknown session is an error."""
    at = os.path.join(folder, "sessions", session)
    if not os.path.isdir(at):
        raise LookupError(f"no session {session}")
    shutil.rmtree(at)


def hook(shell: str, folder: str, session: str, own: str = "scrollsift") -> str:
    """Script for an interactive bash or zsh that lands a record of each command, output left out.

    Empty commands and the engine's own are skipped, as ``recorded`` does.
    """
    if shell not in ("bash", "zsh"):
        raise ValueError(f"no hook for {shell}")
    last, install = {
        "bash": ("$(HISTTIMEFORMAT= history 1 | sed 's/^ *[0-9]* *//')", "PROMPT_COMMAND='_land_command'\"${PROMPT_COMMAND:+;$PROMPT_COMMAND}\""),
        "zsh": ("${history[$((HISTCMD - 1))]}", "autoload -Uz add-zsh-hook && add-zsh-hook precmd _land_command"),
    }[shell]
    return f"""_land_command() {{
  local code=$? line="{last}"
  case "$line" in '' | {own} | '{own} '*) return ;; esac
  line=$(printf '%s' "$line" | sed 's/\\\\/\\\\\\\\/g; s/"/\\\\"/g')
  local at={folder}/$(date +%s%N).json
  printf '{{"type":"capture","session_id":"{session}","timestamp":%s,"command":"%s","output":"","exit_code":%s,"cwd":"%s"}}\\n' "$(date +%s)" "$line" "$code" "$PWD" > "$at.tmp" && mv "$at.tmp" "$at"
}}
{install}
"""
