"""Built-in datasets, one for each kind of task: prompts may have ``{{variables}}``, whose values stand beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Description; then fixed values: version, temperature and most tokens by dataset.
DEFAULTS = {
    "coding-tasks": ("Small programs to write in several languages", "1.0.0", 0.0, 500),
    "reasoning-tasks": ("Questions whose answer has to be worked out", "1.0.0", 0.7, 300),
    "summarization-tasks": ("Passages to shorten without losing what matters", "1.0.0", 0.5, 200),
    "instruction-following": ("Requests with a form that the answer has to keep to", "1.0.0", 0.3, 400),
    "creative-writing": ("Short pieces of free writing", "1.0.0", 0.9, 600),
}
#: Test cases by dataset: (id, prompt, expected, category, variables, references). The ids and the variables are fixed values;
#: prompts and answers are this library's own.
DATASETS = {
    "coding-tasks": (
        ("fizzbuzz-python", "Print the whole numbers up to {{n}} with Python. Multiples of three become Fizz, multiples of five Buzz, and multiples of both get the two words joined.", "print(", "coding", {"n": "100"}, ("% 3", "% 5", "Fizz", "Buzz")),
        ("reverse-string-rust", "In Rust, take a String by value and give back its characters from last to first. Accented letters must survive.", "-> String", "coding", {}, ("String", "collect")),
        ("fibonacci-javascript", "Using {{lang}}, define a recursive routine whose result for n is the sum of its results for the two numbers below n, starting from 0 and 1.", "return", "coding", {"lang": "JavaScript"}, ("n - 1", "n - 2")),
        ("palindrome-checker", "Decide in {{lang}} if a word stays the same when its letters are turned around. Upper and lower case count as equal.", "return", "coding", {"lang": "Python"}, ("[::-1]", "casefold")),
        ("array-sum", "Given a list of numbers, add them all up in {{lang}}; an empty list comes to zero.", "number", "coding", {"lang": "TypeScript"}, ()),
        ("binary-search", "The input is a sorted list. Halve the part still in question until the wanted key is found or nothing is left, in {{lang}}, with a remark on every step.", "return", "coding", {"lang": "Python"}, ("// 2", "#")),
        ("find-duplicates", "With {{lang}}, report each entry of a list that turns up more than once, and report it once.", "Set", "coding", {"lang": "JavaScript"}, ()),
    ),
    "reasoning-tasks": (
        ("logic-puzzle-truthtellers", "On an island, knights never lie and knaves never say anything true. Uma says that Vic is a knave. Vic says that the two of them are of one kind. Which of them is a knight, and why?", "Uma", "reasoning", {}, ("Uma is a knight", "Vic is a knave")),
        ("math-word-problem-distance", "A ferry crosses {{distance}} km of open water and makes {{speed}} km each hour. After how many hours does it land? Give the division that you did.", "3", "reasoning", {"distance": "240", "speed": "80"}, ()),
        ("pattern-recognition", "Each of these numbers follows from the one before it: 3, 6, 12, 24, 48. Name the one after 48.", "96", "reasoning", {}, ()),
        ("age-problem", "A sister is three times as old as her brother today, and four years from now she will be just twice as old as he is then. What are both ages today?", "12", "reasoning", {}, ("sister is 12", "brother is 4")),
        ("river-crossing", "Two adults and two children want to get over a stream in a canoe. It holds one adult or both children, and everybody can paddle. In what order should they cross?", None, "reasoning", {}, ("both children first", "one child returns")),
    ),
    "summarization-tasks": (
        ("summarize-article-short", "Say in a single sentence what this passage tells:\n\nThe harbour of the old town silted up within two centuries. Merchants moved their warehouses ten miles down the coast, where a deeper bay let larger ships land, and the town that had lived on trade turned to weaving. Today its looms are a museum, and the bay is the busiest port of the region.", None, "summarization", {}, ("harbour", "weaving", "port")),
        ("summarize-bullet-points", "Give this back as a list of three short points:\n\nThe new library opens at seven in the morning so that commuters can return books on the way to work. Its reading rooms are heated by warmth from the bakery next door. Members vote each spring on which magazines to order.", None, "summarization", {}, ("opens at seven", "bakery", "vote")),
        ("extract-key-points", "Name the {{n}} statements that a reader of this note should keep in mind:\n\nThe bridge is closed from Monday for repairs of its bearings. Buses go round by the mill and take twelve minutes longer. Cyclists may use the footbridge if they dismount. The works end before the summer fair.", None, "summarization", {"n": "3"}, ()),
        ("tldr-generation", "A colleague has no time to read this change note. Put it in a line or two:\n\nImports used to stop at the first row that could not be read. They now set such rows aside in a file of their own, go on with the rest, and end with a count of both. The old behaviour can be had with a switch.", None, "summarization", {}, ()),
    ),
    "instruction-following": (
        ("format-numbered-list", "Name {{n}} rivers, each on a line that begins with its number. Nothing else may be in the answer.", None, "instruction-following", {"n": "three"}, ("1.", "2.", "3.")),
        ("format-json", "Describe a bicycle as one JSON object whose only keys are brand (text), gears (a number) and colour (text). The answer begins with the opening brace and ends with the closing one.", None, "instruction-following", {}, ("\"brand\"", "\"gears\"", "\"colour\"")),
        ("multi-step-instructions", "Do three things, one after another, under the headings A, B and C: name a vegetable, spell it backwards, and give the number of its letters.", None, "instruction-following", {}, ()),
        ("word-limit", "Tell a child what the tides are. Your answer has {{words}} words, neither fewer nor more.", None, "instruction-following", {"words": "50"}, ()),
        ("avoid-word", "Describe how snow comes about, but never write the word 'water'.", None, "instruction-following", {}, ()),
        ("format-csv", "Make up a table of three plants as comma-separated values: first the line plant,height_cm,months, then a line for each of them.", None, "instruction-following", {}, ("plant,height_cm,months",)),
    ),
    "creative-writing": (
        ("story-opening", "Begin a tale that has to do with {{topic}}. A paragraph is enough, but it should make one want the next.", None, "creative-writing", {"topic": "time travel"}, ()),
        ("haiku-nature", "Compose three lines on {{subject}}, the outer ones of five syllables and the middle one of seven.", None, "creative-writing", {"subject": "autumn leaves"}, ("three lines", "five, seven and five")),
        ("product-description", "A shop is to sell a {{product}}. Write the card beside it that says what sets it apart from others.", None, "creative-writing", {"product": "smart coffee mug"}, ()),
        ("dialogue-scene", "Two neighbours wait for the same late bus. Let them talk for a dozen lines, and let the reader guess what one of them is hiding.", None, "creative-writing", {}, ()),
        ("metaphor-explanation", "Make {{concept}} clear to somebody by likening it to a thing from daily life, and keep to that one likeness.", None, "creative-writing", {"concept": "cloud computing"}, ()),
        ("limerick", "Rhyme five lines about {{subject}} in the manner of a limerick: the long ones end alike, and so do the short ones.", None, "creative-writing", {"subject": "programming bugs"}, ()),
    ),
}
SCHEMA = """dataset string, id string, prompt string, expected string, category string, variables map<string,string>, references array<string>,
    description string, version string, temperature double, max_tokens int"""


def datasets(spark: SparkSession) -> DataFrame:
    """One row per test case, with its dataset's defaults. Cases without variables have an empty map."""
    rows = [(name, *case[:5], list(case[5]), *DEFAULTS[name]) for name, cases in DATASETS.items() for case in cases]
    return spark.createDataFrame(rows, SCHEMA)
