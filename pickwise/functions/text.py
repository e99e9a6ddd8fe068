"""Column functions for prompts, answers and verdicts (JVM regex / string functions only).

Every function maps a Column to a Column, so a whole reply table is parsed in
one projection with no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickwise.functions.columns import col

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Answer-letter pattern: optional "the answer is" prefix, first letter in range, any case.
LETTER_PREFIX = r"(?:the answer is:?\s*)?"
# Prompt tails asking for the final answer line.
CHOICE_TAIL_MMLU = ("Please solve this step by step, then output your answer on a new line as 'The answer is: X' "
                    "where X is A, B, C, or D.")
CHOICE_TAIL_LETTER = ("Please solve this step by step, then output your answer on a new line as 'The answer is: X' "
                      "where X is the letter corresponding to your choice.")
OPEN_TAIL = "Please solve this step by step, then output your answer on a new line as 'The answer is: X'"
DEFAULT_SUBJECT = "mathematics"
# Subject groups used to filter MMLU.
COLLEGE_SUBJECTS = ["college_biology", "college_chemistry", "college_computer_science",
                    "college_mathematics", "college_medicine", "college_physics"]
PROFESSIONAL_SUBJECTS = ["professional_accounting", "professional_law", "professional_medicine",
                         "professional_psychology"]
# Step separator of the process reward model prompt and its system line.
STEP_SYSTEM = "Please reason step by step."
STEP_SEPARATOR = "<extra_0>"
# Judge prompts (reasoning verdict and paragraph critique).
JUDGE_SYSTEM = (
    "You are a rigorous evaluator for reasoning tasks spanning mathematics, science, coding, logic, and other technical domains. Your task is to determine if a given solution demonstrates valid reasoning and reaches the correct conclusion.\n"
    "    \n"
    "    Evaluate the solution against the relevant criteria such as:\n"
    "    - Validity of logical arguments and inference steps \n"
    "    - Correctness of mathematical calculations and methodology\n"
    "    - Proper handling of assumptions and edge cases\n"
    "    - Accuracy of domain-specific concepts and claims\n"
    "    - Appropriate use of computational techniques (if applicable)\n"
    "    - Completeness of key reasoning steps\n"
    "    \n"
    "    First, analyze the solution by carefully examining the reasoning and steps presented. Provide a detailed analysis that:\n"
    "    - Identifies the key reasoning components\n"
    "    - Evaluates the validity of each major step\n"
    "    - Notes any gaps or potential issues\n"
    "    - Assesses the correctness of the conclusion\n"
    "    \n"
    "    Then respond with EXACTLY \"True\" if you have high confidence the solution demonstrates valid reasoning and reaches the correct conclusion, or \"False\" if you have meaningful doubts.\n"
    "    \n"
    "    Your response should be structured as:\n"
    "    1. Your complete analysis and reasoning \n"
    "    2. A single line containing only \"True\" or \"False\" \n"
    "\n"
    "    You must include your final verdict of True or False on a new line at the end of your response.")
JUDGE_USER = ("Problem: {instruction}\n\nSolution to evaluate:\n{sample}\n\n"
              "Analyze the reasoning and solution, then on a new line state True or False:")
CRITIQUE_SYSTEM = ("You are a rigorous evaluator for mathematical and technical solutions. Your task is to analyze "
                   "a solution paragraph by paragraph and identify the earliest error, if any exists.")
CRITIQUE_USER = ("The following is a math problem and a solution (split into paragraphs, enclosed with tags and "
                 "indexed from 0):\n\n[Math Problem]\n{instruction}\n\n[Solution]\n{solution}\n\n"
                 "Your task is to review and critique the solution paragraph by paragraph. Once you identify an "
                 "error in a paragraph, return the index of the paragraph where the earliest error occurs. "
                 "Otherwise, return the index of -1 (which typically denotes \"not found\").\n\n"
                 "Please put your final answer (i.e., the index) in \\boxed{}.")
# Judge prompts for generated scenes (verdict and critique).
SCENE_SYSTEM = (
    "You are a rigorous evaluator for determining whether a scene is valid and high quality with respect to a given prompt.\n"
    "\n"
    "    The scene will be represented as a JSON with a list of objects and a floor layout. The floor layout will be represented as a list of vertices and faces.\n"
    "    Each object will be represented by a unique name, category, position, size, forward direction, right direction, and up direction.\n"
    "    \n"
    "    Evaluate the scene against the relevant criteria such as:\n"
    "    - Whether the right objects are present in the scene\n"
    "    - Physically plausible placement of objects, such as grounding and intersections\n"
    "    - Making sure objects are in bounds of the floor layout\n"
    "    - Accessible and navigable arrangement of the space\n"
    "    - Proper commonsense relationships between objects and the space\n"
    "\n"
    "    For instance, if objects intersect or float in the air when they should be on the ground, this is an error. Or if objects are not accessible or\n"
    "    prevent parts of the room from being accessed, this is an error. If objects do not face the correct direction, this is an error. Check for other \n"
    "    errors of similar nature.\n"
    "    \n"
    "    Then respond with EXACTLY \"True\" if you have high confidence the scene is valid, or \"False\" otherwise.\n"
    "    \n"
    "    Your response should be structured as:\n"
    "    A single line containing only \"True\" or \"False\" \n"
    "\n"
    "    You must include your final verdict of True or False on a new line at the end of your response.")
SCENE_USER = "Prompt: {instruction}\n\nScene to evaluate:\n{sample}\n\nAnalyze the scene, then on a new line state True or False:"
SCENE_CRITIQUE_SYSTEM = "You are a rigorous evaluator for determining whether a scene is valid and high quality with respect to a given prompt."
SCENE_CRITIQUE_USER = (
    "The following is a prompt and a scene (split into paragraphs, enclosed with tags and indexed from 0):\n\n[Prompt]\n{instruction}\n\n[Scene]\n{sample}\n\n"
    "Your task is to review and critique the different components of the scene. Once you identify an error, return the objects involved in the error and the "
    "nature of the error. Otherwise, return \"No errors found\".\n\n"
    "Please put your final answer (i.e., the objects involved in the error and the nature of the error) in \\boxed{}.")
# ---------------------------------------------------------------------------

def strip_ws(c) -> Column:
    """Python str.strip(): remove leading and trailing whitespace (spaces, tabs, newlines)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def letters(n_options: int = 4) -> str:
    return "A-" + chr(64 + n_options)


def extract_letter(c, n_options: int = 4, mode: str = "loose") -> Column:
    """Answer letter of a reply, upper case, or NULL.

    loose (as the reference): leftmost "[the answer is] X" or bare letter X, any case (Q6);
    strict: the last "the answer is: X" with X a whole word."""
    c = col(c)
    if mode == "strict":
        pat = rf"(?i)the answer is:?\s*\(?([{letters(n_options)}])\)?\b"
        got = F.element_at(F.regexp_extract_all(c, F.lit(pat), 1), -1)
        return F.when(F.size(F.regexp_extract_all(c, F.lit(pat), 1)) > 0, F.upper(got))
    got = F.regexp_extract(c, rf"(?i){LETTER_PREFIX}([{letters(n_options)}])", 1)
    return F.when(got != "", F.upper(got))


def extract_boxed(c) -> Column:
    """Content of the last \\boxed{...} whose braces balance, at any depth; NULL if none.

    The reply is cut into braces, ``\\boxed{`` and the plain runs between them, and folded with
    a stack of open braces: the balanced box that closes last is the answer. No recursive
    pattern, so length and depth are not limited."""
    c = col(c)
    pieces = F.regexp_extract_all(c, F.lit(r"\\boxed\{|[{}]|[^{}\\]+|\\"), F.lit(0))
    opened = "array<struct<boxed:boolean,at:int>>"
    start = F.struct(F.array().cast(opened).alias("open"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(s, piece):
        boxed, opens, closes = piece == "\\boxed{", piece.isin("\\boxed{", "{"), (piece == "}") & (F.size(s["open"]) > 0)
        top = F.get(s["open"], F.size(s["open"]) - 1)
        found = closes & top["boxed"]
        stack = (F.when(opens, F.concat(s["open"], F.array(F.struct(boxed.alias("boxed"), s["at"].alias("at")))))
                 .when(closes, F.slice(s["open"], 1, F.size(s["open"]) - 1)).otherwise(s["open"]))
        return F.struct(stack.alias("open"), (s["at"] + 1).alias("at"), F.when(found, top["at"]).otherwise(s["first"]).alias("first"),
                        F.when(found, s["at"]).otherwise(s["last"]).alias("last"))

    end = F.aggregate(pieces, start, step)
    body = F.array_join(F.slice(pieces, end["first"] + 2, end["last"] - end["first"] - 1), "")
    return F.when(c.contains("\\boxed{"), F.when(end["first"] >= 0, body))


def normalize_answer(c) -> Column:
    """Strip a leading "the answer is:", whitespace and an outer \\boxed{...}; \\frac{a}{b} -> a/b,
    \\sqrt{a} -> the radical sign followed by a."""
    c = col(c)
    lowered = F.lower(c)
    a = F.when(lowered.startswith("the answer is:"), strip_ws(F.substring(c, 15, 1 << 30))).otherwise(c)
    a = strip_ws(a)
    boxed = r"^\\boxed\{(.*)\}"
    a = F.when(a.rlike(boxed), F.regexp_extract(a, boxed, 1)).otherwise(a)
    a = F.regexp_replace(a, r"\\frac\{(\d+)\}\{(\d+)\}", "$1/$2")
    a = F.regexp_replace(a, r"\\sqrt\{(\d+)\}", "\u221a$1")
    return a


def verify_choice(extracted, truth) -> Column:
    """Letter answers: NULL or empty -> false; else stripped upper-case equality."""
    e, t = col(extracted), col(truth)
    return F.when(e.isNull() | (e == ""), F.lit(False)).otherwise(
        F.coalesce(F.upper(strip_ws(e)) == F.upper(strip_ws(t)), F.lit(False)))


def verify_math(extracted, truth) -> Column:
    """Math answers without a model: equality of the normalised strings (NULL -> false)."""
    return F.coalesce(normalize_answer(extracted) == normalize_answer(truth), F.lit(False))


def parse_verdict(c) -> Column:
    """1.0 / 0.0 from 'true' / 'false' (lower-cased, 'true' checked first) in the last line,
    then the first line, then the last sentence, then the first sentence; else NULL."""
    t = F.lower(strip_ws(col(c)))
    lines = F.split(t, "\n")
    last_line, first_line = strip_ws(F.element_at(lines, -1)), strip_ws(F.element_at(lines, 1))
    sents = F.split(t, r"\.")
    last_s, first_s = strip_ws(F.element_at(sents, -1)), strip_ws(F.element_at(sents, 1))
    out = None
    for part in (last_line, first_line, last_s, first_s):
        for word, val in (("true", 1.0), ("false", 0.0)):
            cond = part.contains(word)
            out = F.when(cond, F.lit(val)) if out is None else out.when(cond, F.lit(val))
    return out


def parse_critique(c) -> Column:
    """Last \\boxed{<int>}: -1 -> 1.0 (no error found), any other index -> 0.0, none -> NULL."""
    allm = F.regexp_extract_all(col(c), F.lit(r"\\boxed\{(-?\d+)\}"), 1)
    last = F.element_at(allm, -1)
    return F.when(F.size(allm) > 0, F.when(last.rlike("^-0*1$"), 1.0).otherwise(0.0))


def choices_text(options) -> Column:
    """'A) opt\\nB) opt...' from an array of options."""
    return F.array_join(F.transform(col(options), lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), x)), "\n")


def paragraphs_tagged(c) -> Column:
    """Split on blank lines and wrap paragraph i in <paragraph_i> ... </paragraph_i> tags."""
    parts = F.split(col(c), "\n\n")
    return F.array_join(F.transform(parts, lambda x, i: F.concat(
        F.lit("<paragraph_"), i.cast("string"), F.lit(">\n"), x, F.lit("\n</paragraph_"), i.cast("string"),
        F.lit(">"))), "\n")


def fill_template(template: str, **cols) -> Column:
    """Substitute {name} fields of a fixed template with columns (literal text kept as is)."""
    import re

    pieces, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) not in cols:
            continue
        pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(col(cols[m.group(1)]))
        pos = m.end()
    pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)
