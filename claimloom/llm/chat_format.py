"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines.

States are (role, first or later line of a turn). A line emits its speaker marker (a word at
its start with a delimiter), the delimiter's shape, its length class, whether it ends a
question and whether the line before is blank; features are independent given the state.
Probabilities are counted, smoothed, on transcripts whose roles are known; Viterbi gives
the likeliest path, and each turn is rendered in one canonical form, without its marker.

Rendering escapes marks inside turns, and ``parse`` reads it back. Null and empty transcripts have no turns and
render as an empty text. A transcript is tagged whole, in memory that grows with its number of lines. Turns that repeat an index
stay, in the order of (turn, role, text); null roles are taken as user, null texts as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import draw

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
#: Marker styles of the transcripts that ``transcripts`` writes: before, after, and names by role.
STYLES = [
    ("", ": ", ("System", "User", "Assistant")), ("", ": ", ("Instructions", "Human", "AI")), ("### ", ":\n", ("System", "Instruction", "Response")),
    ("[", "] ", ("SYS", "USER", "BOT")), ("<|", "|>\n", ("system", "user", "assistant")), ("**", ":** ", ("Context", "Question", "Answer")), ("", "> ", ("sys", "me", "bot")), ("", " - ", ("Note", "Q", "A")),
]
MARKER = re.compile(r"^([^\w\s]{0,4}\s?)([A-Za-z]{1,14})(\|>|:\*\*|\]|:|>| -)(?:\s+|$)")
TRAIN_CONVERSATIONS = 2_000


def marker(line: str) -> tuple[str, str, str]:
    """(word, delimiter, rest); the word is empty where there is none."""
    m = MARKER.match(line)
    return (m[2].lower(), m[1].strip() + m[3].strip(), line[m.end() :]) if m else ("", "", line)


def observe(lines: list[str]) -> list[tuple]:
    out, blank = [], True
    for line in lines:
        word, mark, rest = marker(line)
        n = len(rest)
        out.append((word, mark, 0 if not n else 1 + min(3, n // 60), rest.rstrip().endswith("?"), blank))
        blank = not line.strip()
    return out


class Tagger:
    """Counts of starts, moves and features by state."""

    def __init__(self) -> None:
        self.start: Counter = Counter()
        self.move: dict = defaultdict(Counter)
        self.emit: list[dict] = [defaultdict(Counter) for _ in range(5)]
        self.seen: list[set] = [set() for _ in range(5)]

    def count(self, lines: list[str], states: list[int]) -> None:
        for k, (o, s) in enumerate(zip(observe(lines), states, strict=True)):
            if k:
                self.move[states[k - 1]][s] += 1
            else:
                self.start[s] += 1
            for f, v in enumerate(o):
                self.emit[f][s][v] += 1
                self.seen[f].add(v)

    def _log(self, counts: Counter, value, kinds: int) -> float:
        return math.log((counts[value] + 0.1) / (sum(counts.values()) + 0.1 * kinds))

    def viterbi(self, lines: list[str]) -> list[int]:
        n = len(STATES)
        if not lines:
            return []
        move = [[self._log(self.move[a], b, n) for b in range(n)] for a in range(n)]
        memo: dict = {}

        def given(o: tuple) -> list[float]:
            if o not in memo:
                memo[o] = [sum(self._log(self.emit[f][s], v, len(self.seen[f]) + 1) for f, v in enumerate(o)) for s in range(n)]
            return memo[o]

        seen = observe(lines)
        best = [self._log(self.start, s, n) + (0 if STATES[s][1] else -50) + given(seen[0])[s] for s in range(n)]
        back = []
        for o in seen[1:]:
            own, e, from_ = [], given(o), []
            for s in range(n):
                # a later line keeps its turn's role
                options = [a for a in range(n) if STATES[s][1] or STATES[a][0] == STATES[s][0]]
                a = max(options, key=lambda a: best[a] + move[a][s])
                own.append(best[a] + move[a][s] + e[s])
                from_.append(a)
            best = own
            back.append(from_)
        path = [max(range(n), key=best.__getitem__)]
        for from_ in reversed(back):
            path.append(from_[path[-1]])
        return path[::-1]


def write_transcript(turns: list[tuple[str, str]], style: int) -> tuple[str, list[int]]:
    """A transcript of (role, text) turns and the state of every line."""
    before, after, names = STYLES[style % len(STYLES)]
    lines, states = [], []
    for role, text in turns:
        r = ROLES.index(role) if role in ROLES else 1
        own = f"{before}{names[r]}{after}{text}".rstrip().split("\n")
        lines += own
        states += [2 * r] + [2 * r + 1] * (len(own) - 1)
    return "\n".join(lines), states


def turns_of(transcript: str | None, tagger: Tagger) -> list[tuple[str, str]]:
    lines = transcript.split("\n") if transcript else []
    out: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, tagger.viterbi(lines), strict=True):
        role, first = STATES[s]
        if first or not out:
            out.append((role, [marker(line)[2]]))
        else:
            out[-1][1].append(line)
    return [(r, "\n".join(x).strip()) for r, x in out]


def escaped(text: str) -> str:
    """With one more backslash in what could be a mark, so that no text can forge a turn."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{escaped(t)}\n<|end|>\n" for r, t in turns)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns that ``render`` wrote."""
    return [(m[1], re.sub(r"<(\\*)\\\|", r"<\1|", m[2])) for m in re.finditer(r"(?s)<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", rendered)]


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): one conversation is one document."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def fit(conversations: DataFrame, train: int = TRAIN_CONVERSATIONS) -> Tagger:
    """Counts on about ``train`` conversations, each written in every style."""
    all_ = conversations.select("conv_id").distinct()
    share = train / max(1, all_.count())
    picked = conversations.where(draw(F.col("conv_id"), "chat") < share)
    tagger = Tagger()
    for r in gathered(picked).orderBy("conv_id").collect():
        for style in range(len(STYLES)):
            text, states = write_transcript([(t["role"], t["text"]) for t in r["turns"]], style)
            tagger.count(text.split("\n"), states)
    return tagger


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, text, roles): conversations as plain transcripts, in a style drawn by conv_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[(t["role"], t["text"]) for t in turns] for turns in b.column(1).to_pylist()]
            styles = b.column(2).to_pylist()
            text = [write_transcript(t, s)[0] for t, s in zip(got, styles, strict=True)]
            roles = [",".join(r if r in ROLES else "user" for r, _ in t) for t in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(roles, pa.string())], names=["conv_id", "text", "roles"])

    style = F.floor(draw(F.col("conv_id"), "style") * len(STYLES)).cast("int")
    return gathered(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), "turns", style.alias("style")).mapInArrow(run, "conv_id long, text string, roles string")


def format_chats(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs`` (conv_id, text, roles) with n_turns, roles_pred and the canonical rendering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [turns_of(t, tagger) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(t) for t in got], pa.int64()), pa.array([",".join(r for r, _ in t) for t in got], pa.string()), pa.array([render(t) for t in got], pa.string())],
                names=["conv_id", "roles", "n_turns", "roles_pred", "rendered"])

    return docs.select("conv_id", "text", "roles").mapInArrow(run, "conv_id long, roles string, n_turns long, roles_pred string, rendered string")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = format_chats(transcripts(given), fit(given))
    return got.select("conv_id", "n_turns", "roles", "roles_pred", (F.col("roles") == F.col("roles_pred")).alias("recovered"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))
