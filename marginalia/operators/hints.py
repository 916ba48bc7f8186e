"""What to do next, by workflow place and tool."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import NoteError
from marginalia.operators.workflow import available

# Hint texts that clients of the tools see.
PLACE_HINTS = {
    "idle": [
        "Use 'search' to find notes by keyword or semantic query.",
        "Use 'vault list' to browse the vault structure.",
        "Use 'workflow status' to check current state.",
    ],
    "exploring": [
        "Use 'open_note' to open a note for editing.",
        "Use 'refine' to narrow your search with different terms.",
        "Use 'view' to read note content or fragments.",
        "Use 'reset' to return to idle.",
    ],
    "editing": [
        "Use 'save' after making changes to move to review.",
        "Use 'back' to return to exploring without saving.",
        "Use 'edit' with append/prepend/replace to modify the note.",
        "Use 'view' to check the current note content.",
    ],
    "reviewing": [
        "Use 'done' to finish and return to idle.",
        "Use 'open_note' to edit another note.",
        "Use 'search' to start a new exploration.",
        "Review changes and verify they are correct.",
    ],
}
TOOL_HINTS = {
    "vault": {
        "idle": ["List notes to discover vault structure.", "Create a new note with 'vault create'."],
        "exploring": ["Check if a note exists before opening.", "Get note metadata with 'vault stat'."],
        "editing": ["Read the full note before making changes."],
        "reviewing": ["Re-read the modified note to verify changes."],
    },
    "edit": {
        "idle": ["Search for a note first, then open it for editing."],
        "exploring": ["Open a note before editing it."],
        "editing": [
            "Use 'append' to add content under a heading.",
            "Use 'replace' to swap content at a heading or block.",
            "Use 'prepend' to insert content at the top of a section.",
            "Target by heading (title + depth) or block ID (^id).",
        ],
        "reviewing": ["Re-open the note if further edits are needed."],
    },
    "view": {
        "idle": ["Search for notes to find relevant content."],
        "exploring": [
            "Use fragment retrieval to read only relevant sections.",
            "View headings outline to understand note structure.",
        ],
        "editing": ["Preview a specific section before modifying it."],
        "reviewing": ["Read the full note to review all changes."],
    },
    "workflow": {
        "idle": ["Check workflow status to see available actions.", "Start a new workflow with 'search'."],
        "exploring": ["Transition to editing with 'open_note'.", "Refine search or reset to idle."],
        "editing": ["Save changes or go back to exploring."],
        "reviewing": ["Mark as done or continue editing."],
    },
    "system": {
        "idle": ["Check system status and indexing progress.", "Trigger re-indexing if needed."],
        "exploring": ["Check if the vector index is up to date."],
        "editing": ["System tools are available at any time."],
        "reviewing": ["Verify the index after editing notes."],
    },
}


def hints_for(place: str, tool: str) -> dict:
    return {
        "currentState": place,
        "nextActions": PLACE_HINTS[place],
        "availableTransitions": available(place),
        "toolHints": TOOL_HINTS[tool][place],
    }


def hint_table(spark: SparkSession) -> DataFrame:
    """``tool, place, next_actions, available_transitions, tool_hints``: 20 rows."""
    rows = [(t, p, PLACE_HINTS[p], available(p), hints) for t, by in TOOL_HINTS.items() for p, hints in by.items()]
    return spark.createDataFrame(
        rows, "tool string, place string, next_actions array<string>, available_transitions array<string>, tool_hints array<string>"
    )


def with_hints(states: DataFrame, place: str, tool: str) -> DataFrame:
    """Add hints to rows that carry a workflow place (the hint table has 20 rows)."""
    table = hint_table(states.sparkSession).filter(F.col("tool") == tool).drop("tool").withColumnRenamed("place", place)
    return states.join(F.broadcast(table), place, "left")


def envelope(place: str, tool: str, result: object) -> str:
    """JSON answer of a tool call."""
    return json.dumps({"result": result, "hints": hints_for(place, tool)}, ensure_ascii=False, default=str)


def error_text(exc: Exception) -> str:
    return f"[{exc.code}] {exc}" if isinstance(exc, NoteError) else str(exc)
