"""A model by rules, for reports without a service: it groups lines by what they say."""

from __future__ import annotations

import re


def grouping_backend():
    """Groups labelled lines by what they say and replies in blocks."""

    def table(number: int, title: str, heading: str, groups: dict[str, list[str]]) -> str:
        rows = [f"{name},{', '.join(ids)},seen {name}" for name, ids in sorted(groups.items())]
        body = "\n".join([f"{title},,,", f"{heading},Matching Test IDs,Example", *rows])
        return f"---BLOCK{number}_START---\n{body}\n---BLOCK{number}_END---\n"

    def reply(topic: str, lines: list[str]) -> str:
        if topic == "observations":
            rows = "\n".join(f"Observed,{line.replace(',', ';')}" for line in lines)
            return f"---BLOCK3_START---\nKey Observations,,,\n{rows}\n---BLOCK3_END---"
        if topic == "merge":  # its names are the same in every part
            return ""
        groups: dict[str, list[str]] = {}
        for line in lines:
            if topic == "evaluations":
                found = re.match(r"\[Test ID: (\d+)\] Eval: score (\d+)", line)
                groups.setdefault(f"Score {found[2]}", []).append(found[1])
            else:
                found = re.match(r"\[Test ID: (\d+)\] Input: (\w+), Output: (\S+)", line)
                groups.setdefault(f"{found[2]} to {found[3]}", []).append(found[1])
        if topic == "evaluations":
            return table(1, "Failure Reason Breakdown", "Failure / Issue Type", groups)
        return table(2, "Language Issue Breakdown", "Language Problem Type", groups)

    return reply


def part_names_backend():
    """The same with names of its own in every call, and merging of such names."""
    group = grouping_backend()

    def reply(topic: str, lines: list[str]) -> str:
        if topic != "merge":
            named = group(topic, lines)
            return re.sub(r"(?m)^(Score \d+),", lambda m: f"{m[1]} as of {len(lines)} lines,", named)
        groups: dict[str, list[str]] = {}
        for line in lines:
            found = re.match(r"\[Issue: (\d+)\] (Score \d+)", line)
            groups.setdefault(found[2], []).append(found[1])
        rows = "\n".join(f"{name},{', '.join(ids)},{len(ids)} names" for name, ids in sorted(groups.items()))
        return f"---BLOCK1_START---\nMerged,,,\nIssue,Matching Test IDs,Example\n{rows}\n---BLOCK1_END---"

    return reply
