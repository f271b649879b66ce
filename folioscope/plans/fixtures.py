"""Small fixed inputs of queries, with the results that hold for them where these are stated."""

from __future__ import annotations

NOW = "2026-01-01 00:00:00"

#: (line, dropped)
LINES = [
    ("12", True), ("- 4 -", True), ("Page 3 of 9", True), ("03/04/2021", True), ("March 3, 2020", True), ("mail@host.org", True), ("https://host.org/a", True),
    ("DOI: 10.1/x", True), ("Figure 2 shows the layout of the plant", True), ("Lab 4", True), ("Sorting ......... 12", True), ("Sorting networks (page 9)", True),
    ("The year 1999 saw many changes in this field", False), ("A plain sentence about trees.", False), ("", False),
]

#: (doc_id, line_no, text, size, page): a body at 10 points and four larger lines.
FONT_LINES = [("d", k, f"body line {k}", 10.0, 1) for k in range(20)] + [("d", 20, "Title", 20.0, 1), ("d", 21, "Part", 14.0, 1), ("d", 22, "Detail", 12.0, 1), ("d", 23, "2024", 20.0, 1)]

#: (text, flags)
FLAGS = [
    ("As a Figure here and a table there", "figure"), ("For example, take two", "example"), ("see fig.2 and, for instance, this diagram", "example,figure"),
    ("see fig. 2", ""), ("many figures", ""), ("a case study of trees", "example"),
]

DEFINED = ["that", "the", "it"]

#: (kind, text, a, b, result)
PREDICATES = [
    ("match", "Deep neural-networks learn", "neural network", "", True),
    ("match", "the policies of it", "policy", "", True),
    ("match", "a subnetwork", "network", "", False),
    ("match", "neural\nnetwork", "neural network", "", False),
    ("match", "two boxes", "box", "", True),
    ("match", "anything", "", "", False),
    ("define", "A neural network is a model of neurons.", "neural network", "", True),
    ("define", "This is known as overfitting in practice.", "overfitting", "", True),
    ("define", "Overfitting: when a model memorises.", "overfitting", "", True),
    ("define", "Overfitting is shown in the plot.", "overfitting", "", False),
    ("outside", "A neural network is a graph", "network", "neural network", False),
    ("outside", "A neural network is a network", "network", "neural network", True),
    ("depends", "A transformer is a type of neural network.", "transformer", "neural network", True),
    ("depends", "Backpropagation relies on the chain rule.", "backpropagation", "chain rule", True),
    ("depends", "Gradients are used by gradient descent.", "gradient descent", "gradient", True),
    ("depends", "Transformers and networks were compared.", "transformer", "network", False),
    ("special", "", "network", "neural networks", True),
    ("special", "", "learning", "learning rate", False),
    ("special", "", "", "network", False),
]

EDGES = [("a", "b", 0.5), ("a", "c", 0.25), ("b", "c", 0.75), ("c", "d", 0.1)]
DAG = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d"), ("e", "d"), ("e", "f")]
RANKINGS = [(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 3), (1, 1, 3, 1), (1, 1, 1, 2), (2, 0, 9, 1)]

#: (message, small talk, the reply's rule)
SMALL_TALK = [
    ("Hi!", True, "greeting"), ("thanks so much", True, "thanks"), ("Good night", True, "goodbye"), ("OK, cool", False, "agreement"), ("ok there", True, "agreement"),
    ("Define overfitting", False, "greeting"), ("ty", True, "thanks"), ("hello assistant", True, "greeting"), ("Bye again!", True, "goodbye"), ("What is hi", False, "greeting"),
]

#: (reply, topics)
TOPIC_REPLIES = [
    ('{"topics": ["gradient descent", "x", " loss "]}', "gradient descent|loss"),
    ('["a1", 3, "b2"]', "a1|b2"),
    ('{"concepts": ["one"], "other": ["two"]}', "one"),
    ('{"n": 1, "list": ["tree", "heap"]}', "tree|heap"),
    ('Here you go: ["stack", "queue"] and more', "stack|queue"),
    ("no list at all", ""),
]
#: (proposal, term)
RAW_TERMS = [('  "Gradient  descent." ', "Gradient descent"), ("the", None), ("x", None), ("12 34", None), ("a b c d e f g", None), ("• Trees;", "Trees")]
#: (reply, question, answer)
QUIZ_REPLIES = [
    ('{"question": " What is a tree? ", "answer": "a graph"}', "What is a tree?", "a graph"),
    ('{"question": "short", "answer": "a"}', None, None),
    ('{"question": "What is a tree like?", "answer": " "}', None, None),
    ("not json", None, None),
    ('["a"]', None, None),
]
#: (reply, score, feedback)
GRADE_REPLIES = [
    ('{"score": 85, "feedback": "good"}', 0.85, "good"), ('{"score": 0.4}', 0.4, None), ('{"score": 1.5, "feedback": " "}', 0.015, None), ("garbage", None, None),
    ('{"score": -3}', 0.0, None), ('{"score": "0.5"}', 0.5, None),
]

#: term (an event type), tier, score, position in the course
COURSE = [("click", "core", 1.0, 1), ("purchase", "core", 0.8, 2), ("view", "supporting", 0.5, 3), ("scroll", "minor", 0.25, 4), ("unseen topic", "minor", 0.2, 5)]
COURSE_EDGES = [("click", "purchase"), ("unseen topic", "scroll"), ("purchase", "view")]

#: (answer, expected, score, "I don't know")
ANSWERS = [
    ("neural networks", "neural network", 1.0, False), ("neural netwrk", "neural network", 0.75, False), ("banana", "neural network", 0.0, False), ("", "tree", 0.0, False),
    ("it is a tree", "tree", 1.0, False), ("I don't know", "tree", 0.0, True), ("idk", "tree", 0.0, True), ("I don't know exactly but a tree has nodes", "tree", 1.0, False), ("???", "tree", 0.0, True),
]
BLENDS = [(None, 0.5), (1.0, 0.25), (0.5, 0.9), (0.9, 0.74), (None, 0.1)]
#: (id, kind, answer, expected, model, cosine)
ROUTED = [
    (1, "cloze", "trees", "tree", None, 0.1), (2, "short", "  ", "tree", 1.0, 0.9), (3, "short", "a graph", "a tree", 0.5, 0.5), (4, "short", "a graph", "a tree", None, 0.5),
    (5, "short", "no idea", "tree", 1.0, 0.9), (6, "cloze", "tere", "tree", None, None),
]
