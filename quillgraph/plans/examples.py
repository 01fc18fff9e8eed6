"""Example questions.

Fixed values: the questions that users are shown, in order.
"""

from __future__ import annotations

QUESTIONS = (
    "Who founded Aether Analytics?",
    "What does Aether Analytics develop?",
    "Who works at Aether Analytics?",
    "Who works on OrionEdge?",
    "Who leads Project Aurora?",
    "Who collaborates with Arun Mehta?",
    "Who partnered with Aether Analytics?",
    "Where is OrionEdge deployed?",
    "Who uses OrionEdge?",
    "Who improved the Entity Resolution Engine?",
    "What is integrated into OrionEdge?",
    "Who is the customer of Aether Analytics?",
)

EXAMPLES = (
    "Who founded Aether Analytics?",
    "What does Aether Analytics develop?",
    "Who works on OrionEdge?",
    "Who leads Project Aurora?",
    "Where is OrionEdge deployed?",
    "Who uses OrionEdge?",
    "How is Nila Rao connected to Aether Analytics?",
    "Who leads GraphMatch?",
    "Where is GraphMatch deployed?",
    "Who founded the Resolution Working Group?",
    "Who works on AuditLens?",
    "What is integrated into OrionEdge?",
    "How is Dmitri Volkov connected to Helios Bank?",
    "Who founded the company that developed Starship?",
    "What does the organization that NASA partners with develop?",
)

MULTI_HOP = (
    "Who founded the company that developed Starship?",
    "What does the organization that NASA partners with develop?",
    "Who founded the organization that partnered with the organization that develops Firefox?",
    "Who works on the product developed by the company founded by Elon Musk?",
    "What does the company that uses Firefox focus on?",
    "Who developed the product that the organization partnered with Quantum Forge develops?",
    "Who founded the organization that developed the Turing machine?",
    "What does the organization that founded the Turing Award develop?",
    "Who collaborated with the person who developed the incompleteness theorems?",
    "What does the organization that developed the von Neumann architecture focus on?",
)
