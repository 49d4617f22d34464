"""Runs saved SQL files: includes expanded, statements told apart by Spark's own lexer, stopped at the first failure."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Token:
    """A token of Spark's SQL lexer: its symbolic name, its text, and the line it begins on (from 1)."""

    kind: str
    text: str
    line: int


def tokens(spark: SparkSession, text: str) -> Iterator[Token]:
    """All tokens of a script in order, remarks and white space among them."""
    jvm = spark._jvm
    parser = jvm.org.apache.spark.sql.catalyst.parser
    lexer = parser.SqlBaseLexer(parser.UpperCaseCharStream(jvm.org.antlr.v4.runtime.CharStreams.fromString(text)))
    lexer.removeErrorListeners()
    names = lexer.getVocabulary()
    for t in lexer.getAllTokens():
        yield Token(names.getSymbolicName(t.getType()), t.getText(), t.getLine())


REMARKS = ("SIMPLE_COMMENT", "BRACKETED_COMMENT")


def statements(spark: SparkSession, text: str) -> list[tuple[int, str]]:
    """(line, statement) of a script: the line it begins on, remarks before it among it; those of remarks and blanks alone
    are left out. A semicolon in a string, a quoted name or a remark ends none."""
    out, now, real, line = [], [], False, 1
    for t in [*tokens(spark, text), Token("SEMICOLON", ";", 0)]:
        if t.kind == "SEMICOLON":
            if real:
                out.append((line, "".join(now).strip()))
            now, real = [], False
            continue
        if not "".join(now).strip() and t.kind != "WS":
            now, line = [], t.line
        now.append(t.text)
        real = real or t.kind not in (*REMARKS, "WS")
    return out


def expand(path: Path, seen: tuple[Path, ...] = ()) -> str:
    """The file's text with each '.read other.sql' line replaced by that file."""
    path = path.resolve()
    if path in seen:
        raise ValueError("include cycle: " + " -> ".join(p.name for p in (*seen, path)))
    out = []
    for line in path.read_text(encoding="utf-8").splitlines():
        found = re.match(r"\s*\.read\s+(\S+)\s*$", line)
        out.append(expand(path.parent / found[1], (*seen, path)) if found else line)
    return "\n".join(out)


def run(spark: SparkSession, path: str) -> list[DataFrame]:
    """A DataFrame for each statement; an error ends the run and names its statement."""
    found = []
    for i, (_, s) in enumerate(statements(spark, expand(Path(path))), 1):
        try:
            found.append(spark.sql(s))
        except Exception as e:
            raise RuntimeError(f"{path}: statement {i} failed: {s[:80]}") from e
    return found
