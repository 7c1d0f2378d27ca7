"""Detectors of design patterns as tables of rules, in the forms of `detectors`.

This family has its own features and its own final form of the score: a rule's points
may grow with a count, scores are not held above zero, and graphs alone make no high one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.plans import scoring
from graphloom.plans.detectors import CLASS, body, both, either, flag, has, least, method, name, no, signals, some, word

#: Counts are of members of the node; types are texts of a checker, empty where there is none.
FEATURES = (
    "kind string, name string, text string, base_name string, base_class string, decorators array<string>, parameter_decorators array<string>, interfaces array<string>, methods array<string>, method_texts array<string>, "
    "properties array<string>, property_types array<string>, parameters array<string>, constructor_types array<string>, call_texts array<string>, array_calls array<string>, listener_types array<string>, returned_classes array<string>, "
    "restricted_constructor boolean, static_instances int, static_accessors int, dependencies int, parameter_properties boolean, outer_news int, news int, uses_dependency boolean, branches int, abstract_return boolean, "
    "notify_loops boolean, emit_loops boolean, implementations int, interface_parameters int, orchestrators int, short_orchestrators int, dependency_calls int, chainable int, terminal boolean, terminal_news int, "
    "dependency_properties int, wrapped_parameters int, converts boolean, object_transform boolean, exports int, star_exports int, exported_names int"
)

_CRUD = "(?i)^(find|get|list|save|create|update|delete|remove|insert|upsert|count|query)"
_WRAPPED = r"this\.(inner|wrapped|delegate|next)\."
_STORES = r"\.set\(|\[.*\]\s*=|\.get\(|resolve\s*\("
_BOTH_ENDS = r"(?is)commit.*rollback|rollback.*commit|try.*commit.*catch.*rollback"
FUNCTION = ("function", "method")


def _signature(*names: str) -> tuple:
    return both(*[has("parameters", (n,)) for n in names])


def _rule(text: str, points, condition: tuple, area: str = "local") -> tuple:
    return text, points, "none", condition, area


#: pattern -> kinds of candidates, rules, penalties, as in `detectors`.
# Points and patterns.
RULES: dict[str, tuple[tuple[str, ...], list[tuple], list[tuple]]] = {
    "singleton": (CLASS, [
        _rule("restricted constructor", 3, flag("restricted_constructor")),
        _rule("static instance property", 2, least("static_instances", 1)),
        _rule("static same-class accessor", 2, least("static_accessors", 1), "type"),
    ], [(1.5, both(no(flag("restricted_constructor")), least("static_instances", 1)))]),
    "dependency_injection": (CLASS, [
        _rule("constructor non-primitive dependencies", (2, 0.5, "dependencies", 4), least("dependencies", 1), "type"),
        _rule("constructor parameter property", 2, both(least("dependencies", 1), flag("parameter_properties"))),
        _rule("DI decorator", 2, either(has("decorators", ("Injectable", "Service", "Inject")), has("parameter_decorators", ("Inject",)))),
        _rule("few direct new expressions", 1, both(no(least("outer_news", 1)), least("dependencies", 1))),
        _rule("injected dependency usage", 2, flag("uses_dependency")),
    ], [(1.5, ("more", "outer_news", "dependencies"))]),
    "factory": (("class", *FUNCTION), [
        _rule("factory name", 1.5, name("(?i)Factory$|^create|^make|factory")),
        _rule("constructs objects", (2, 0.25, "news", 3), least("news", 1)),
        _rule("returns constructed object", 2, ("size", "returned_classes", 1)),
        _rule("branching concrete construction", 2.5, both(least("branches", 1), ("different", "returned_classes", 2))),
        _rule("abstract return type", 2, both(has("kind", FUNCTION), flag("abstract_return")), "type"),
    ], []),
    "observer": (CLASS, [
        _rule("observer API", 2.5, method("subscribe", "unsubscribe", "notify")),
        _rule("listener collection", 2, ("size", "listener_types", 1)),
        _rule("callback invocation loop", 3, both(some("methods", "(?i)^(notify|publish|broadcast)$"), flag("notify_loops"))),
    ], []),
    "interface_based": (("interface", "class"), [
        _rule("interface declaration", 1.5, has("kind", ("interface",))),
        _rule("classes implement interface", (2, 0.5, "implementations", 4), both(has("kind", ("interface",)), least("implementations", 1)), "type"),
        _rule("implements interface", 2, both(has("kind", CLASS), ("size", "interfaces", 1)), "type"),
        _rule("interface-typed dependencies", 2, both(has("kind", CLASS), least("interface_parameters", 1)), "type"),
    ], []),
    "repository": (CLASS, [
        _rule("repository name suffix", 1.5, name("Repository$")),
        _rule("CRUD-like methods", (1, 0.5, ("methods", _CRUD), 3), ("count", "methods", _CRUD, 2)),
        _rule("database dependency", 2, either(some("properties", "(?i)db|database|client|model|prisma|knex|sequelize|dataSource|connection"), some("constructor_types", "Db|Database|Client|Model|Prisma|Knex|DataSource|Connection")), "type"),
    ], []),
    "service": (CLASS, [
        _rule("service name suffix", 1.25, name("Service$")),
        _rule("service dependencies", (2, 0.5, ("constructor_types", "Repository|Client|Gateway|Mapper|Bus|Service|UseCase"), 4), some("constructor_types", "Repository|Client|Gateway|Mapper|Bus|Service|UseCase"), "type"),
        _rule("orchestrates dependencies", 2.5, least("orchestrators", 1)),
    ], []),
    "strategy": (("interface", "class"), [
        _rule("multiple implementations", 4, both(has("kind", ("interface",)), least("implementations", 2)), "type"),
        _rule("strategy abstraction name", 1, both(has("kind", ("interface",)), name("Strategy|Policy|Algorithm|Rule"))),
        _rule("consumer accepts abstraction", 2.5, both(has("kind", CLASS), either(some("constructor_types", "Strategy|Policy|Algorithm|Rule"), least("interface_parameters", 1))), "type"),
        _rule("strategy method call", 1.5, both(has("kind", CLASS), some("call_texts", "(?i)strategy|policy|rule|algorithm"))),
    ], []),
    "builder": (CLASS, [
        _rule("builder name suffix", 1.5, name("Builder$")),
        _rule("chainable methods", (2, 0.5, "chainable", 4), least("chainable", 2), "type"),
        _rule("terminal build method", 2, flag("terminal")),
        _rule("product construction", 2, both(flag("terminal"), least("terminal_news", 1))),
        _rule("state accumulation", 1, ("size", "properties", 2)),
    ], []),
    "adapter": (CLASS, [
        _rule("adapter name suffix", 1.5, name("Adapter$")),
        _rule("implements target interface", 2, ("size", "interfaces", 1), "type"),
        _rule("wrapped dependency", 2, either(least("dependency_properties", 1), some("properties", "(?i)client|adaptee|legacy|external|sdk|api"))),
        _rule("delegates to wrapped object", 2, some("call_texts", r"(?i)this\.(client|adaptee|legacy|external|sdk|api)\.")),
        _rule("translation behavior", 1.5, either(("size", "array_calls", 1), flag("converts"))),
    ], []),
    "facade": (CLASS, [
        _rule("facade name suffix", 1.5, name("Facade$")),
        _rule("multiple subsystem dependencies", 2.5, either(least("dependency_properties", 2), least("dependencies", 2)), "type"),
        _rule("simple orchestration entrypoint", 3, least("short_orchestrators", 1)),
    ], []),
    "decorator": (CLASS, [
        _rule("same-interface wrapping", 4, both(("size", "interfaces", 1), least("wrapped_parameters", 1)), "type"),
        _rule("decorator name suffix", 1.25, name("Decorator$")),
        _rule("delegates to wrapped object", 2, some("call_texts", _WRAPPED)),
        _rule("before after behavior", 2, ("some_both", "method_texts", "(?i)before|after|log|metric|validate|authorize|cache", _WRAPPED)),
    ], []),
    "proxy": (CLASS, [
        _rule("proxy name suffix", 1.5, name("Proxy$")),
        _rule("same or similar interface", 1.5, ("size", "interfaces", 1), "type"),
        _rule("target wrapping", 1.5, either(least("dependencies", 1), least("dependency_properties", 1))),
        _rule("control behavior", 2, body("(?i)cache|lazy|authorize|auth|permission|remote|retry|guard|memo")),
        _rule("conditional delegation", 1.5, both(least("branches", 1), some("call_texts", r"this\."))),
    ], []),
    "command": (("class", "object"), [
        _rule("command name suffix", 1.25, name("Command$")),
        _rule("execute method", 3, either(both(has("kind", CLASS), method("execute")), both(has("kind", ("object",)), body(r"execute\s*[:(]")))),
        _rule("dispatch or undo semantics", 1.5, body("undo|redo|dispatch|handler|bus|queue")),
        _rule("payload or dependencies", 1.5, both(has("kind", CLASS), either(("size", "properties", 1), ("size", "constructor_types", 1))), "type"),
    ], []),
    "middleware": (("class", *FUNCTION), [
        _rule("middleware signature", 3, both(has("kind", FUNCTION), either(_signature("req", "res", "next"), _signature("ctx", "next")))),
        _rule("calls next continuation", 2.5, body(r"\bnext\s*\(")),
        _rule("middleware naming or registration hint", 1, either(name("Middleware$"), body(r"use\s*\("))),
    ], []),
    "event_emitter": (CLASS, [
        _rule("event emitter API", 2.5, method("on", "off", "once", "emit")),
        _rule("extends EventEmitter", 3, word("base_class", "EventEmitter"), "type"),
        _rule("event-key listener store", 2, some("listener_types", "Map|Record|Object|Array|Set")),
        _rule("emit dispatch", 2.5, both(some("methods", "(?i)^emit$"), flag("emit_loops"))),
    ], []),
    "registry": (CLASS, [
        _rule("registry/container name", 1.5, name("Registry|Container|Resolver")),
        _rule("register resolve API", 2, method("register", "resolve", "get", "set", "has")),
        _rule("keyed storage", 2, either(some("property_types", "Map|Record|Object|WeakMap"), some("properties", "(?i)registry|items|handlers|providers|tokens")), "type"),
        _rule("dynamic store and lookup", 2, body(_STORES)),
    ], []),
    "plugin": (("interface", "class", "function", "method", "object", "file"), [
        _rule("plugin interface", 2, both(has("kind", ("interface",)), name("Plugin|Extension"))),
        _rule("plugin class name", 1.5, both(has("kind", CLASS), name("Plugin|Extension|Host"))),
        _rule("plugin lifecycle methods", 2, body(r"\b(install|register|activate|load|dispose|initialize)\b")),
        _rule("extension registration or dynamic load", 2, body(r"import\s*\(|require\s*\(|loadPlugin|plugins\s*[:=]|\.register\(")),
    ], []),
    "mapper": (("class", *FUNCTION), [
        _rule("mapper name", 1.5, name("Mapper$|^(to|from|mapTo|mapFrom)[A-Z]|Dto|Entity|Domain")),
        _rule("different parameter and return types", 2, both(has("kind", FUNCTION), flag("converts")), "type"),
        _rule("object literal transformation", 2, flag("object_transform")),
        _rule("array transformation behavior", 1.5, some("array_calls", r"\.map\(|\.flatMap\(|\.reduce\(")),
    ], []),
    "module_boundary": (("file",), [
        _rule("barrel index file", 2, word("base_name", r"^index\.[cm]?tsx?$")),
        _rule("re-export surface", (1, 0.5, "exports", 3), least("exports", 1)),
        _rule("export star", 1.5, least("star_exports", 1)),
        _rule("public API surface", 2, least("exported_names", 3), "type"),
    ], []),
    "unit_of_work": (("class", *FUNCTION), [
        _rule("transactional name", 1.5, name("UnitOfWork|Transaction|Transactional")),
        _rule("transaction lifecycle", 3, body(r"(?i)\b(begin|commit|rollback|transaction|tx|withTransaction)\b")),
        _rule("multiple repository operations", 2.5, either(body("(?s)Repository.*Repository"), least("dependency_calls", 2)), "type"),
        _rule("commit rollback wrapping", 2.5, body(_BOTH_ENDS)),
    ], []),
}


def detect(candidates: DataFrame, keys: list[str], graph: DataFrame | None = None, level: str = "low") -> DataFrame:
    """Detections (keys, pattern, score, confidence, detected, rules, strong) of a level or higher; `graph` has more signals of area `graph` or `call`."""
    s = signals(candidates, keys, RULES)
    if graph is not None:
        s = s.unionByName(graph)
    return scoring.at_least(scoring.finish_architecture(s, [*keys, "pattern"]).where("detected"), level)
