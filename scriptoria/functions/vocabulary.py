"""Constant tables of the operators; every operator takes them as parameters."""

from __future__ import annotations

# Manual sections in their order, with placeholder token and keywords.
SECTIONS = [
    ("Overview", "[[NEEDS_OVERVIEW]]", ["overview"]),
    ("Purpose & Problem Solving", "[[NEEDS_PURPOSE]]", ["purpose", "problem", "objective", "goal"]),
    ("How to Run", "[[NEEDS_RUN_INSTRUCTIONS]]", ["how to run", "usage", "running", "execution", "run"]),
    ("Inputs", "[[NEEDS_INPUTS]]", ["input", "inputs"]),
    ("Outputs", "[[NEEDS_OUTPUTS]]", ["output", "outputs"]),
    ("System Requirements", "[[NEEDS_REQUIREMENTS]]", ["system requirements", "requirements", "dependencies"]),
    ("Examples", "[[NEEDS_EXAMPLES]]", ["example", "examples"]),
]

# Phrases of an assistant, and terms foreign to documentation.
ASSISTANT_PHRASES = ["you can", "note that", "this summary", "here's how", "to run", "we can", "let's", "should you", "if you want"]
FOREIGN_TERMS = ["tic-tac-toe", "checkers", "pizza", "weather", "recipe"]

# Lines that a summary must not hold.
BAD_STARTS = [
    "summarize", "you are", "you can", "note that", "the code above", "this script", "here's how", "to run this", "let's", "for example",
    "you might", "we can", "should you", "if you want", "the summary", "this explanation", "this output", "this description", "this response",
]
BAD_PARTS = ["documentation engine", "summarize the following", "as an ai language model", "as a language model", "as an ai model", "i am an ai", "i'm an ai"]
BAD_META = ["this summary", "this output", "this response", "does not include", "avoids addressing"]

# The texts sent to a model.
SYSTEM_PROMPT = (
    "You are not an assistant. You are a documentation engine that generates factual summaries of code files. "
    "Do not help the user. Do not refer to yourself. Do not explain what you are doing. Only describe what the code defines or implements."
)
_RULES = (
    "- Do not refer to yourself, the summary, or the response.\n"
    "- Do not include instructions, usage advice, or disclaimers.\n"
    "- Do not say what is or isn't included in the code.\n"
    "- Do not explain how to run it.\n"
    '- Do not use phrases like "this script", "the code above", or "you can".\n'
    "- Just describe what is implemented.\n\n"
)
_CODE = "Code:\n```python\n{text}\n```"
PROMPTS = {
    "module": "Summarize the module below.\n\n" + _RULES + _CODE,
    "class": "Summarize the class below.\n\n" + _RULES + _CODE,
    "function": "Summarize the function below.\n\n" + _RULES + _CODE,
    "readme": (
        "You are a documentation engine.\n\nBelow is Markdown content from a README or documentation file. "
        "Use this to enrich the overall project summary. Focus on describing the code’s purpose, features, and architecture.\n\n"
        "- Do not include setup or installation steps\n- Do not refer to the Markdown file itself\n- Avoid list formatting or markdown\n"
        "- Output 2–3 sentences suitable for use in technical documentation\n- Do not speculate. Use only the provided content.\n{text}"
    ),
    "project": (
        "You are a documentation generator.\n\nWrite a short project summary using only the information provided below.\n"
        "Do not make assumptions. Do not explain how to run the code.\n"
        "Do not mention imports or visualization libraries unless explicitly listed.\n"
        'Do not say "the script starts by" or "you can".\nAvoid assistant-like phrasing. Just summarize what the code does.\n\n{text}'
    ),
    "docstring": "{text}",
    "user_manual": (
        "Given the following context and documentation files, generate a clear, detailed User’s Manual for a technically literate audience. Cover: "
        "purpose, problem it solves, how to run it, input/output specs, and examples if possible.\n\n{text}"
    ),
}
MERGE_INSTRUCTIONS = (
    "You are a documentation generator.\n\nCombine the following summaries into a single technical paragraph.\n"
    "Do not critique, evaluate, or offer suggestions.\nDo not speculate or use uncertain language.\n"
    "Only summarize what the code explicitly defines.\n\n"
)

# Folders whose evidence is suppressed, and folders that ranking skips.
EVIDENCE_SKIP = ["tests", "examples", "fixtures"]
RANKING_SKIP = ["venv", ".git", "__pycache__", "node_modules", "dist", "build", "tests", "test", "examples", "example", "samples", "sample", "fixtures", "fixture"]
RANKING_SUFFIXES = [".py", ".m", ".ipynb", ".cpp", ".h", ".java"]
RANKING_WORDS = ["run", "main", "cli", "config", "io", "dataset", "reader", "writer", "pipeline"]
REFERENCE_SUFFIXES = ["py", "m", "md", "rst", "txt", "json", "yaml", "yml", "csv"]
IO_WORDS = ["path", "file", "config", "io"]

# File suffixes of the scan, by format.
SCAN_SUFFIXES = {".py": "python", ".m": "matlab", ".cpp": "cpp", ".h": "cpp", ".java": "java", ".js": "javascript", ".ts": "typescript", ".slx": "simulink", ".mdl": "simulink"}


def prompt_lines() -> list[str]:
    """Distinct lines of all prompts, stripped and in lower case, in order."""
    texts = [*(t.replace("{text}", "") for t in PROMPTS.values()), SYSTEM_PROMPT]
    return list(dict.fromkeys(line.strip().lower() for t in texts for line in t.splitlines() if line.strip()))
