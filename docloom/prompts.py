"""What a language model is told: roles and bodies of each task, in Polish as its answers are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = {
    "SUMMARY": "Jesteś asystentem, który streszcza dokumenty.",
    "SUMMARY_PART": "Jesteś asystentem, który streszcza dokumenty.",
    "CATEGORY_SUBCATEGORY": "Jesteś asystentem, który przypisuje dokumentom kategorie.",
    "DEPARTMENT_ASSIGNMENT": "Jesteś asystentem, który kieruje dokumenty do działów.",
    "BASE_EXTRACTION": "Jesteś asystentem, który wypisuje dane z dokumentów.",
    "CHECK_CONFIDENTIAL": "Jesteś asystentem, który rozpoznaje rodzaje danych wrażliwych.",
    "SUGGESTED_ACTION": "Jesteś asystentem, który doradza, co zrobić z dokumentem.",
}
BODIES = {
    "SUMMARY": "Napisz formalne streszczenie dokumentu w jednym akapicie, bez list i nagłówków.",
    "SUMMARY_PART": "Streść krótko podaną część dokumentu; zachowaj daty, kwoty i nazwy.",
    "CATEGORY_SUBCATEGORY": "Wskaż jedną kategorię z listy, a jeśli ma podkategorie, także jedną z nich.\nLista:\n",
    "DEPARTMENT_ASSIGNMENT": "Wskaż jeden dział z listy.\nLista:\n",
    "BASE_EXTRACTION": "Wypisz najważniejsze dane dokumentu jako pary pole i wartość.",
    "CHECK_CONFIDENTIAL": "Powiedz, czy dokument zawiera dane wrażliwe, i podaj same ich rodzaje, nigdy treść. Rodzaje:\n",
    "SUGGESTED_ACTION": "Zaproponuj w jednym akapicie, co należy zrobić w sprawie opisanej w dokumencie.",
}
REPAIR = "Poprzednia odpowiedź nie pasowała do formatu lub listy. Użyj tylko wartości z listy i podaj poprawny obiekt."
#: Some models keep to Polish only when told so in English first.
PRIMED = ("qwen",)
PRIMER = "You are a helpful assistant. All instructions are in Polish and every answer must be in Polish."


def primed(model: str) -> bool:
    return any(p in model.lower() for p in PRIMED)


def system(task: str, model: str = "", listing: Column | None = None) -> Column:
    """Role and body of a task, with the list to choose from where there is one."""
    start = F.lit(f"{PRIMER if primed(model) else ROLES[task]}\n\n{BODIES[task]}")
    return start if listing is None else F.concat(start, F.coalesce(listing, F.lit("")))


def repair_system(told: Column) -> Column:
    return F.concat(told, F.lit(f"\n\n{REPAIR}"))


def repair_prompt(prompt: Column, rejected: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n[Odrzucona odpowiedź]:\n"), F.coalesce(rejected, F.lit("")))


def category_listing(categories: Column) -> Column:
    """``- name: sub, sub`` lines of ``array<struct<name, subs>>``."""
    line = lambda c: F.concat(F.lit("- "), c["name"], F.when(F.coalesce(F.size(c["subs"]), F.lit(0)) > 0, F.concat(F.lit(": "), F.array_join(c["subs"], ", "))).otherwise(F.lit("")))
    return F.array_join(F.transform(categories, line), "\n")


def department_listing(departments: Column) -> Column:
    """``- name: description`` lines of ``array<struct<name, description>>``; the description may be missing."""
    line = lambda d: F.concat(F.lit("- "), d["name"], F.when(F.coalesce(d["description"], F.lit("")) != "", F.concat(F.lit(": "), d["description"])).otherwise(F.lit("")))
    return F.array_join(F.transform(departments, line), "\n")


def rag_parts(model: str = "") -> tuple[str, str, str]:
    """What stands before the fragments, the rules after them, and the rule for a search over all documents."""
    head = (f"{PRIMER}\n\n" if primed(model) else "") + "Odpowiadasz na pytania o dokumenty.\nFragmenty, z których wolno korzystać:\n"
    rules = "ZASADY:\n1. Opieraj się tylko na podanych fragmentach.\n2. Jeśli nie ma w nich odpowiedzi, napisz, że dokumenty jej nie zawierają.\n3. Pisz krótko i rzeczowo.\n"
    return head, rules, "4. Na końcu podaj nazwy dokumentów, z których pochodzi odpowiedź.\n"


def rag_system(context: Column, everywhere: Column, model: str = "") -> Column:
    """System prompt of an answer from fragments; a search over all documents also has to name its sources."""
    head, rules, names = rag_parts(model)
    return F.concat(F.lit(head), F.coalesce(context, F.lit("")), F.lit(rules), F.when(everywhere, F.lit(names)).otherwise(F.lit("")))
