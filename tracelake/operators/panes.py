"""Analytics over captured terminal panes: status, project, crash candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a pane's text says about it, in the order of the checks.
ATTENTION = [
    r"\bgoal blocked\b", r"\bstatus:\s*blocked\b", r"\btask blocked\b", r"\bblocked (by|on|waiting|until)\b", r"\bblocked\s*\(/goal resume\)",
    r"\bwaiting for (user|approval|input|confirmation)\b", r"\bneeds? (attention|approval|input|user)\b", r"\bapproval (required|requested|needed)\b",
    r"\btrust (this )?(folder|workspace|directory)\b", r"\bdo you trust\b", r"\bpermission\b.*\b(allow|approve|denied|required)\b", r"\b(allow|approve|confirm|proceed)\?\s*$", r"\bpress enter to continue\b",
]
ACTIVE = [
    r"\bworking\s*\(",
    r"\bpursuing goal\b",
    r"\brunning (command|tool|tests?|build|typecheck)\b",
    r"\b(tool|model) activity\b",
    r"\bcalling tool\b",
    r"\bexecuting\b"
]
IDLE = [
    r"\bgoal achieved\b", r"\bgoal completed\b", r"\bgoal complete\b", r"\bno active goal\b", r"\bwhat do you want", r"\bnew task\?\s+/clear\b", r"\btype (a )?message",
    r"(?m)(^|\n)\s*>\s*$", r"(?m)(^|\n)\s*›\s*.*$", r"(?m)(^|\n)[^\n@]+@[^:\n]+:[^\n]*[$#]\s*$",
]
SHELLS = ["", "bash", "zsh", "sh", "fish", "dash", "tmux", "login", "ssh", "sudo", "su", "cd"]
CRASHED = ["bash", "sh"]


def _any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, in one pass; a pattern keeps the flags that it begins with."""
    one = [f"(?m:{p.removeprefix('(?m)')})" if p.startswith("(?m)") else f"(?:{p})" for p in patterns]
    return F.coalesce(text.rlike("(?i)" + "|".join(one)), F.lit(False))


def _said(text: Column) -> Column:
    return F.when(_any(text, ATTENTION), "needs_attention").when(_any(text, ACTIVE), "active").when(_any(text, IDLE), "idle")


def visible_lines(text: Column, most: int = 12) -> Column:
    """The last ``most`` lines that are not blank, without terminal escapes."""
    plain = F.regexp_replace(F.regexp_replace(text, "\u001b(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])", ""), "\r", "")
    kept = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    return F.slice(kept, F.greatest(F.size(kept) - most + 1, F.lit(1)), most)


def classified(panes: DataFrame) -> DataFrame:
    """``panes`` (command, pane_dead, captured_text) with ``status``: dead, or the last line, the last three, the last twelve, the command."""
    told = panes.withColumn("_lines", visible_lines(F.coalesce("captured_text", F.lit(""))))
    line = lambda k: F.coalesce(F.get("_lines", F.size("_lines") - k), F.lit(""))
    command = F.when(F.lower("command").isin(*SHELLS), "idle").otherwise("active")
    status = F.when(F.col("pane_dead"), "dead").otherwise(
        F.coalesce(_said(line(1)), _said(line(2)), _said(line(3)), _said(F.array_join("_lines", "\n")), command)
    )
    return told.withColumn("status", status).drop("_lines")


def project_of(path: Column, session: Column, prefix: str) -> tuple[Column, Column]:
    """(path, slug): the nearest ancestor whose name begins with ``prefix``, else the path itself."""
    parts = F.split(F.regexp_replace(path, "(?<=.)/+$", ""), "/")
    at = F.coalesce(F.array_max(F.transform(parts, lambda p, k: F.when(F.lower(p).startswith(prefix), k + 1))), F.lit(0))
    at = F.when(path.startswith("/"), at).otherwise(0)
    found = F.when(at > 0, F.array_join(F.slice(parts, 1, at), "/")).otherwise(path)
    base = F.substring_index(F.coalesce(found, session), "/", -1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.when(base != "", base).otherwise(session)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return found, F.when(slug != "", slug).otherwise("unknown")


def status_order() -> list[Column]:
    rank = F.when(
        F.col("status") == "needs_attention",
        0
    ).when(F.col("status") == "active", 1).when(F.col("status") == "idle", 2).otherwise(3)
    return [rank, F.col("session"), F.col("window_index"), F.col("pane_index")]


def sorted_by_status(panes: DataFrame) -> DataFrame:
    return panes.orderBy(*status_order())


def listing(panes: DataFrame, machines: list[str] | None = None, status: str | None = None, project: str | None = None) -> DataFrame:
    """Panes of the given machines, status and project, with ``pos``: their order on the machine."""
    told = panes if machines is None else panes.where(F.col("machine").isin(*machines))
    told = told if status is None else told.where(F.col("status") == status)
    told = told if project is None else told.where(F.col("slug") == project)
    return told.withColumn("pos", F.row_number().over(W.partitionBy("machine").orderBy(*status_order())))


def crash_candidates(panes: DataFrame, healthy: str = "agent", shells: list[str] = CRASHED) -> DataFrame:
    """session, window_index, status: primary panes that are dead or back at a shell while a numbered sibling runs."""
    prefix = F.regexp_replace(F.regexp_replace("session", r"[-_.]?\d+$", ""), r"[-_.]+$", "")
    told = panes.where("window_name = session").withColumn(
        "prefix",
        F.when((prefix != "") & (prefix != F.col("session")), prefix)
    ).withColumn("cmd", F.lower(F.trim("command")))
    alive = told.where(
        ~F.col("pane_dead") & (F.col("cmd") == healthy) & F.col("prefix").isNotNull()
    ).groupBy("prefix").agg(F.count_distinct("session").alias("n"), F.min("session").alias("one"))
    status = F.when(F.col("pane_dead"), "dead").when(F.col("cmd").isin(*shells), "crashed")
    bad = told.withColumn("status", status).where("status is not null").join(alive, "prefix").where("n > 1 or one <> session")
    order = W.partitionBy("session", "window_index").orderBy(F.desc(F.col("status") == "dead"), "pane_index")
    return bad.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("session", "window_index", "status", "cwd")


def fleet_summary(panes: DataFrame) -> DataFrame:
    return panes.groupBy("machine", "status").agg(F.count("*").alias("panes"))
