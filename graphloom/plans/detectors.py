"""Detectors of application patterns as tables of rules over features of code nodes.

A candidate is one row of `FEATURES`: a class, interface, function, method, object
literal, call or source file with what was read from its syntax; type texts are empty
where no checker provides them, which only lowers scores.  A rule is data: a pattern,
points, a strength, and a condition built from a few forms (`word`, `some`, `has`,
`flag`, `least`, and, or, not), which one pass evaluates as column expressions over all
patterns at once.  Nothing is joined to nothing: detectors meet candidates in columns.

`condition` renders the forms for Spark; `sql` renders them as plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans import scoring

#: Arrays hold names or texts of the node's members; numbers count syntax below it.
FEATURES = (
    "kind string, name string, text string, file_path string, file_text string, imports array<string>, decorators array<string>, member_decorators array<string>, "
    "method_decorators array<string>, property_decorators array<string>, parameter_decorators array<string>, methods array<string>, properties array<string>, hidden_properties int, "
    "interfaces array<string>, constructors array<string>, constructor_types array<string>, signatures array<string>, calls array<string>, keys array<string>, arguments string, "
    "entry_text string, entry_calls int, injected boolean, boundary boolean, entry_boundary boolean, terminates boolean, boolean_return boolean, data_shape boolean, registers boolean, "
    "callbacks int, callback_boundary boolean, callback_terminates boolean, inline_route boolean, throws int, loops int, tries int, news int, transforms int, predicates int"
)

# Names that the rules look for.
HTTP = ("Get", "Post", "Put", "Patch", "Delete", "Head", "Options", "All")
CONTROLLERS = ("Controller", "RestController")
GRAPHQL = ("Resolver", "Query", "Mutation", "FieldResolver", "ResolveField", "Subscription")
VALIDATION = ("IsString", "IsEmail", "IsOptional", "IsNotEmpty", "IsUUID", "IsNumber", "IsBoolean", "ValidateNested", "Length", "Min", "Max", "Matches")
ORM = ("Entity", "Column", "PrimaryColumn", "PrimaryGeneratedColumn", "ManyToOne", "OneToMany", "ManyToMany", "OneToOne", "JoinColumn", "CreateDateColumn", "UpdateDateColumn")
SCHEDULING = ("Cron", "Interval", "Timeout", "Scheduled")
QUEUES = ("Processor", "Process", "OnQueueActive", "OnQueueCompleted", "OnQueueFailed", "MessagePattern", "EventPattern")
CACHE_CALLS = ("get", "set", "has", "delete", "clear", "invalidate", "del", "mget", "mset")
FLAG_CALLS = ("isEnabled", "variation", "getFlag", "checkFlag", "enabled", "getVariation", "boolVariation")
VALIDATION_CALLS = ("parse", "safeParse", "validate", "validateSync", "assert", "isValid", "schema")
QUEUE_CALLS = ("process", "consume", "subscribe", "on", "addEventListener", "eachMessage", "handleMessage")
ACK_CALLS = ("ack", "nack", "commit", "commitMessage", "resolveOffset", "reject", "deleteMessage")
SCHEDULE_CALLS = ("schedule", "setInterval", "setTimeout", "cron", "job", "recurrenceRule")
CONTAINER_CALLS = ("register", "bind", "provide", "singleton", "factory", "instance", "asClass", "asValue", "asFunction")
PROVIDER_KEYS = ("provide", "useClass", "useValue", "useFactory", "useExisting", "inject")

CLASS, FUNCTION = ("class",), ("function", "function_expression", "arrow", "method")
ANY = ("class", "interface", "function", "function_expression", "arrow", "method", "object", "call")


def word(column: str, pattern: str) -> tuple:
    return "word", column, pattern


def some(column: str, pattern: str) -> tuple:
    return "some", column, pattern


def has(column: str, names: tuple[str, ...]) -> tuple:
    return "has", column, names


def flag(column: str) -> tuple:
    return ("flag", column)


def least(column: str, n: int) -> tuple:
    return "least", column, n


def both(*of: tuple) -> tuple:
    return ("and", *of)


def either(*of: tuple) -> tuple:
    return ("or", *of)


def no(of: tuple) -> tuple:
    return "not", of


def name(pattern: str) -> tuple:
    return word("name", pattern)


def body(pattern: str) -> tuple:
    return word("text", pattern)


def imported(pattern: str) -> tuple:
    return some("imports", f"(?i){pattern}")


def decorated(names: tuple[str, ...]) -> tuple:
    return either(has("decorators", names), has("member_decorators", names))


def method(*names: str) -> tuple:
    return has("methods", names)


_BOUNDARY = either(flag("boundary"), flag("entry_boundary"))
_LOOPED = both(least("loops", 1), least("tries", 1))
_HTTP = has("method_decorators", HTTP)
_GQL = has("method_decorators", GRAPHQL)
_AUTHORIZES = "^(canActivate|authorize|isAllowed|hasPermission)$"
_ID = "(?i)^id$|Id$|uuid$"
_VALIDATORS = "zod|yup|joi|class-validator|superstruct|valibot"
_QUEUES = "bull|bullmq|amqplib|rabbit|kafkajs|sqs|sns|pubsub|nats"
_CRON = "node-cron|cron|agenda|bree|schedule"
_FLAGS = "launchdarkly|unleash|configcat|splitio|growthbook"
_RETRY = r"p-retry|async-retry|axios-retry|\bretry\b"
_GQL_IMPORT = "graphql|@nestjs/graphql|type-graphql"
_MAIN = r"(?:^|/)(main|bootstrap|app\.module|container|composition-root|compositionRoot)\.tsx?$"
_ORM_TWICE = ("at_least_of", "property_decorators", "decorators", ORM, 2)

#: pattern -> kinds of candidates, rules (rule, points, strength, condition[, area]), penalties (points, condition).
# Points, strengths and patterns.
RULES: dict[str, tuple[tuple[str, ...], list[tuple], list[tuple]]] = {
    "controller": (CLASS, [
        ("controller.name_suffix", 1.5, "weak", name("Controller$")),
        ("controller.class_decorator", 3, "strong", has("decorators", CONTROLLERS)),
        ("controller.http_method_decorators", 2.5, "strong", _HTTP),
        ("controller.constructor_injection", 1.5, "medium", flag("injected")),
        ("controller.boundary_params", 1.2, "medium", flag("boundary")),
        ("controller.response_termination", 1.2, "medium", flag("terminates")),
        ("controller.type_dependency", 1, "medium", some("constructor_types", "Service|UseCase|Interactor|Application|Repository"), "type"),
    ], [(1.5, both(no(has("decorators", CONTROLLERS)), no(_HTTP)))]),
    "route_handler": (("call", *FUNCTION), [
        ("route_handler.registration_call", 3, "strong", both(has("kind", ("call",)), flag("registers"))),
        ("route_handler.callback_argument", 1.5, "strong", both(flag("registers"), least("callbacks", 1))),
        ("route_handler.request_response_params", 1, "medium", both(flag("registers"), flag("callback_boundary"))),
        ("route_handler.response_call", 1.5, "strong", both(flag("registers"), flag("callback_terminates"))),
        ("route_handler.boundary_params", 1.5, "medium", both(has("kind", FUNCTION), flag("boundary"))),
        ("route_handler.response_terminator", 2, "strong", both(has("kind", FUNCTION), flag("terminates"))),
        ("route_handler.inline_route_callback", 2, "strong", both(has("kind", ("arrow",)), flag("inline_route"))),
        ("route_handler.name_suffix", 0.8, "weak", both(has("kind", FUNCTION), name("Handler$|Route$"))),
    ], [(1, both(has("kind", FUNCTION), no(flag("terminates")), no(flag("boundary"))))]),
    "guard": (CLASS, [
        ("guard.name_suffix", 1.5, "weak", name("Guard$")),
        ("guard.interface", 2, "strong", some("interfaces", "(?i)CanActivate|Guard"), "type"),
        ("guard.authorization_method", 2, "strong", some("methods", _AUTHORIZES)),
        ("guard.auth_terms", 1.5, "medium", body("(?i)user|session|role|permission|token|auth|jwt")),
        ("guard.boolean_return", 1, "medium", flag("boolean_return"), "type"),
        ("guard.auth_error", 1, "medium", either(body("(?i)Unauthorized|Forbidden|401|403|AccessDenied"), least("throws", 1))),
        ("guard.pipeline_or_injectable", 0.8, "medium", either(body("UseGuards"), has("decorators", ("Injectable",)))),
    ], [(1.2, both(no(some("methods", _AUTHORIZES.strip("^$"))), no(some("interfaces", "CanActivate"))))]),
    "interceptor": (CLASS, [
        ("interceptor.name_suffix", 1.5, "weak", name("Interceptor$")),
        ("interceptor.interface", 2, "strong", some("interfaces", "(?i)NestInterceptor|Interceptor"), "type"),
        ("interceptor.intercept_method", 2, "strong", method("intercept")),
        ("interceptor.next_handle", 2, "strong", both(method("intercept"), word("entry_text", r"next\.handle\s*\("))),
        ("interceptor.rxjs_or_pipeline", 1.2, "medium", has("calls", ("pipe", "map", "catchError", "tap", "finally", "finalize"))),
        ("interceptor.pipeline_registration", 1, "strong", body("UseInterceptors|APP_INTERCEPTOR")),
    ], [(1, either(no(method("intercept")), no(body(r"next\.handle"))))]),
    "validator": (ANY, [
        ("validator.name_suffix", 1.2, "weak", name("Validator$|Schema$|Validation$")),
        ("validator.library_import", 2, "strong", imported(_VALIDATORS)),
        ("validator.validation_api_call", 2, "strong", has("calls", VALIDATION_CALLS)),
        ("validator.validation_decorators", 2, "strong", decorated(VALIDATION)),
        ("validator.throws_validation_error", 1, "medium", both(body("ValidationError|BadRequest|Invalid|throw"), least("throws", 1))),
        ("validator.validation_result_branch", 1, "medium", both(body("safeParse|parse|validate"), body("success|error|errors"))),
    ], [(1.2, both(no(has("calls", VALIDATION_CALLS)), no(has("decorators", VALIDATION)), no(imported(_VALIDATORS))))]),
    "dto": (("class", "interface"), [
        ("dto.boundary_name", 1.5, "weak", name("Dto$|DTO$|Request$|Response$|Payload$|Input$|Output$|Command$|Query$")),
        ("dto.data_shape", 2, "strong", flag("data_shape")),
        ("dto.no_behavior", 1, "medium", both(has("kind", CLASS), no(("size", "methods", 1)), ("size", "properties", 2))),
        ("dto.validation_serialization_decorators", 1.5, "medium", has("member_decorators", VALIDATION)),
        ("dto_type_composition", 0.8, "medium", body("readonly|Partial<|Pick<|Omit<|Record<"), "type"),
    ], [(1.5, no(flag("data_shape")))]),
    "entity": (CLASS, [
        ("entity.name_suffix", 1.2, "weak", name("Entity$")),
        ("entity.orm_class_decorator", 3, "strong", has("decorators", ("Entity",))),
        ("entity.orm_property_decorators", 2, "strong", _ORM_TWICE),
        ("entity.persistence_fields", 1, "medium", some("properties", "^(id|uuid|createdAt|updatedAt|deletedAt)$")),
        ("entity.persistence_context", 0.8, "medium", word("file_text", r"(?i)Repository|EntityManager|save\(|findOne\(|findMany\(|prisma|typeorm|sequelize|mongoose")),
    ], [(1.5, both(no(has("decorators", ("Entity",))), no(_ORM_TWICE), no(word("file_text", "Repository"))))]),
    "value_object": (CLASS, [
        ("value_object.name_semantics", 1.1, "weak", name("ValueObject$|VO$|Email|Money|Amount|Quantity|Address|Name|Range|Period|Slug|Identifier")),
        ("value_object.immutable_fields", 1.5, "strong", ("all_hidden",)),
        ("value_object_value_semantics", 1.5, "strong", method("equals", "valueOf", "toString")),
        ("value_object_constructor_invariants", 1.3, "strong", some("constructors", r"throw|Invalid|assert|validate|if\s*\(")),
        ("value_object_no_identity", 0.8, "medium", no(some("properties", _ID))),
        ("value_object_immutability_type", 0.8, "medium", body(r"Object\.freeze|Readonly<|private readonly"), "type"),
    ], [(1.5, some("properties", _ID)), (1.5, has("decorators", ORM))]),
    "use_case": (CLASS, [
        ("use_case.name_suffix", 1.5, "weak", name("UseCase$|Interactor$|Action$|CommandHandler$|QueryHandler$")),
        ("use_case.execution_method", 2, "strong", method("execute", "handle", "run")),
        ("use_case.constructor_dependencies", 1.2, "medium", flag("injected")),
        ("use_case_application_dependencies", 1.2, "medium", some("constructor_types", "(?i)Repository|Gateway|Service|Client|UnitOfWork|Bus|Presenter"), "type"),
        ("use_case_input_dto", 0.8, "medium", both(method("execute", "handle", "run"), flag("entry_boundary"))),
        ("use_case_orchestration_calls", 1, "strong", both(method("execute", "handle", "run"), least("entry_calls", 2))),
    ], [(1.5, no(method("execute", "handle", "run")))]),
    "presenter": (("class", "function", "arrow"), [
        ("presenter.name_suffix", 1.2, "weak", name("Presenter$|ViewModel$|Mapper$")),
        ("presenter.transform_method", 2, "strong", both(has("kind", CLASS), some("methods", "^(present|format|toViewModel|toResponse|serialize|map)$"))),
        ("presenter.transform_terms", 1.2, "medium", body("toResponse|toViewModel|present|format|serialize")),
        ("presenter.array_transform", 1, "medium", least("transforms", 1)),
        ("presenter_constructs_output", 0.8, "medium", body(r"return\s*\{|\.map\s*\(")),
        ("presenter_type_boundary_conversion", 1.5, "strong", both(has("kind", CLASS), ("some_both", "signatures", "(?i)Entity|Domain|Result|UseCase", "(?i)Dto|Response|ViewModel|Payload|Output")), "type"),
    ], [(1.2, no(body("present|format|toViewModel|toResponse|serialize|map")))]),
    "resolver": (CLASS, [
        ("resolver.name_suffix", 1.5, "weak", name("Resolver$")),
        ("resolver.class_decorator", 3, "strong", has("decorators", ("Resolver",))),
        ("resolver.graphql_method_decorators", 2, "strong", _GQL),
        ("resolver.graphql_import", 1.5, "strong", imported(_GQL_IMPORT)),
        ("resolver.graphql_args_context", 1.2, "strong", has("parameter_decorators", ("Args", "Context", "Parent", "Info"))),
        ("resolver.injected_dependencies", 1, "medium", flag("injected")),
    ], [(1.5, both(no(has("decorators", ("Resolver",))), no(_GQL), no(imported(_GQL_IMPORT))))]),
    "provider": (("object", "call", "class"), [
        ("provider.object_keys", 3, "strong", both(has("kind", ("object",)), has("keys", ("provide", "useFactory", "useClass")))),
        ("provider.factory", 1.5, "strong", both(has("kind", ("object",)), has("keys", ("useFactory",)))),
        ("provider.inject", 1, "medium", both(has("kind", ("object",)), has("keys", ("inject",)))),
        ("provider.container_registration_call", 2.5, "strong", both(has("kind", ("call",)), has("name", CONTAINER_CALLS))),
        ("provider.registration_provider_shape", 1.2, "medium", both(has("kind", ("call",)), word("arguments", "useClass|useValue|useFactory|provide"))),
        ("provider.injectable_decorator", 1.5, "medium", both(has("kind", CLASS), has("decorators", ("Injectable",)))),
        ("provider.constructor_dependencies", 1, "medium", both(has("kind", CLASS), has("decorators", ("Injectable",)), flag("injected"))),
    ], []),
    "composition_root": (ANY, [
        ("composition_root.file_name", 1.8, "weak", word("file_path", _MAIN)),
        ("composition_root.bootstrap_startup_call", 2.5, "strong", body(r"NestFactory\.create|createApp\(|express\(|fastify\(|new\s+Hono|new\s+Koa|listen\s*\(")),
        ("composition_root_di_wiring", 2, "strong", body(r"container\.|\.register\(|\.bind\(|providers\s*:|imports\s*:|modules\s*:")),
        ("composition_root_concentrated_construction", 1.2, "medium", least("news", 3)),
        ("composition_root_config_env", 0.8, "medium", body(r"process\.env|ConfigService|dotenv|env\.")),
    ], [(1.8, both(no(word("file_path", _MAIN)), no(body(r"listen\s*\(|NestFactory\.create|container\.|providers\s*:"))))]),
    "cache": (ANY, [
        ("cache.name_semantics", 1.2, "weak", name("(?i)Cache|Cached|Memoized|Memo")),
        ("cache.storage_or_library", 2, "strong", either(body(r"(?i)new\s+(Map|WeakMap)\s*\(|Redis|cache-manager|lru-cache|NodeCache"), imported("redis|cache-manager|lru-cache|node-cache|ioredis"))),
        ("cache.cache_api_methods", 1.5, "strong", has("calls", CACHE_CALLS)),
        ("cache_ttl_expiration", 1, "medium", body(r"(?i)ttl|expires|expiration|Date\.now\(|maxAge|stale")),
        ("cache_hit_branch", 1, "strong", body(r"(?s)if\s*\(.+\.has\(|if\s*\(.+\.get\(|return\s+.+\.get\(")),
        ("cache_write_invalidate", 1, "strong", body(r"(?i)\.set\s*\(.+\)|\.delete\s*\(|invalidate")),
    ], [(1.5, both(no(body("(?i)Map|Cache|Redis|memo")), no(name("(?i)Map|Cache|Redis|memo"))))]),
    "retry_policy": (ANY, [
        ("retry.name_semantics", 1.2, "weak", name("(?i)Retry|Backoff|RetryPolicy")),
        ("retry.library_import", 2, "strong", imported(_RETRY)),
        ("retry.loop_try_catch", 2, "strong", _LOOPED),
        ("retry_attempt_counter", 1.2, "medium", body("(?i)attempt|attempts|retries|maxRetries|maxAttempts|retryCount")),
        ("retry_backoff_delay", 1.2, "medium", body("(?i)delay|sleep|backoff|setTimeout|exponential|jitter")),
        ("retry_transient_error", 0.8, "medium", body(r"(?i)catch\s*\(|catch\s*\{|Transient|ECONNRESET|ETIMEDOUT|rate.?limit")),
    ], [(1.5, both(no(_LOOPED), no(imported(_RETRY))))]),
    "circuit_breaker": (ANY, [
        ("breaker.name_semantics", 1.4, "weak", name("(?i)CircuitBreaker|Breaker")),
        ("breaker.library_import", 2, "strong", imported("opossum|cockatiel|circuit-breaker")),
        ("breaker_state_terms", 2, "strong", body("closed|open|halfOpen|half_open|HALF_OPEN|CLOSED|OPEN")),
        ("breaker_failure_threshold", 1.3, "medium", body("(?i)failure|failures|failureCount|threshold|maxFailures")),
        ("breaker_reset_window", 1, "medium", body(r"(?i)reset|timeout|cooldown|window|nextAttempt|Date\.now\(")),
        ("breaker_short_circuit", 1.5, "strong", body(r"(?i)if\s*\(.+open.+\)\s*\{[^}]*throw|short.?circuit|CircuitOpen")),
        ("breaker_error_transition", 1, "medium", both(least("tries", 1), body("(?i)failure|open|threshold"))),
    ], [(1.8, no(body("(?i)open|halfOpen|closed|threshold|opossum")))]),
    "queue_consumer": (ANY, [
        ("queue_consumer.name_suffix", 1, "weak", name("(?i)Consumer$|Worker$|Processor$|Handler$")),
        ("queue_consumer.queue_import", 2, "strong", imported(f"{_QUEUES}|@nestjs/microservices")),
        ("queue_consumer.decorators", 2.2, "strong", decorated(QUEUES)),
        ("queue_consumer.registration_call", 2, "strong", has("calls", QUEUE_CALLS)),
        ("queue_consumer_payload_terms", 1, "medium", body("(?i)job|message|event|payload|record|topic|partition|subscription")),
        ("queue_consumer_ack", 1.2, "strong", has("calls", ACK_CALLS)),
    ], [(1.5, both(no(has("calls", QUEUE_CALLS)), no(has("decorators", QUEUES)), no(imported(_QUEUES))))]),
    "scheduler": (ANY, [
        ("scheduler.name_suffix", 1, "weak", name("(?i)Scheduler$|Job$|Task$")),
        ("scheduler.decorators", 2.5, "strong", decorated(SCHEDULING)),
        ("scheduler.api_call", 2, "strong", has("calls", SCHEDULE_CALLS)),
        ("scheduler.library_import", 1.5, "strong", imported(f"{_CRON}|@nestjs/schedule")),
        ("scheduler_schedule_expression", 1, "medium", body(r"(?i)\* \* \*|cron|every|interval|timeout|recurrence|Date\(|setInterval|setTimeout")),
        ("scheduler_service_dependency", 0.8, "medium", both(has("kind", CLASS), flag("injected"))),
    ], [(1.5, both(no(has("calls", SCHEDULE_CALLS)), no(has("decorators", SCHEDULING)), no(imported(_CRON))))]),
    "feature_flag": (ANY, [
        ("feature_flag.name_semantics", 1, "weak", name("(?i)FeatureFlag|Flag|Experiment|Toggle")),
        ("feature_flag.library_import", 2, "strong", imported(f"{_FLAGS}|feature-flag")),
        ("feature_flag.api_call", 2, "strong", has("calls", FLAG_CALLS)),
        ("feature_flag_conditional_branch", 1.5, "strong", body(r"(?i)if\s*\(.+(flag|toggle|experiment|variation|isEnabled|getFlag)")),
        ("feature_flag_key_literal", 0.8, "medium", body(r"""(?i)['"][a-z0-9_.:-]+(?:flag|experiment|toggle|variant|feature)[a-z0-9_.:-]*['"]""")),
        ("feature_flag_divergent_paths", 0.8, "medium", both(body(r"else|\?\s*.+:"), body("(?i)flag|variation|experiment|toggle"))),
    ], [(1.2, both(no(has("calls", FLAG_CALLS)), no(imported(_FLAGS))))]),
    "specification": (("class", "function", "arrow"), [
        ("specification.name_suffix", 1.2, "weak", name("(?i)Specification$|Spec$|Rule$|Predicate$")),
        ("specification.is_satisfied_by", 2, "strong", both(has("kind", CLASS), method("isSatisfiedBy"))),
        ("specification_composition_methods", 1.5, "strong", both(has("kind", CLASS), method("and", "or", "not"))),
        ("specification_boolean_return", 1, "medium", flag("boolean_return"), "type"),
        ("specification_array_predicate_usage", 1.2, "medium", least("predicates", 1)),
        ("specification_business_predicate", 0.8, "medium", both(body(r"=>\s*.+[=!<>]=|return\s+.+[=!<>]=|&&|\|\|"), body("(?i)domain|entity|item|candidate|value|rule|policy"))),
    ], [(1.2, no(body(r"isSatisfiedBy|filter|some|every|and\(|or\(|not\(")))]),
}


def condition(c: tuple) -> Column:
    """A condition as a column of false or true; nulls are false."""
    form, *a = c
    if form == "word":
        x = F.col(a[0]).rlike(a[1])
    elif form == "some":
        x = F.exists(a[0], lambda v: v.rlike(a[1]))
    elif form == "some_both":
        x = F.exists(a[0], lambda v: v.rlike(a[1]) & v.rlike(a[2]))
    elif form == "has":
        x = F.col(a[0]).isin(*a[1]) if a[0] in ("kind", "name") else F.arrays_overlap(a[0], F.array(*[F.lit(v) for v in a[1]]))
    elif form == "flag":
        x = F.col(a[0])
    elif form == "least":
        x = F.col(a[0]) >= a[1]
    elif form == "size":
        x = F.size(a[0]) >= a[1]
    elif form == "count":
        x = F.size(F.filter(a[0], lambda v: v.rlike(a[1]))) >= a[2]
    elif form == "more":
        x = F.col(a[0]) > F.col(a[1])
    elif form == "different":
        x = F.size(F.array_distinct(a[0])) >= a[1]
    elif form == "all_hidden":
        x = (F.size("properties") > 0) & (F.col("hidden_properties") >= F.size("properties"))
    elif form == "at_least_of":
        x = F.size(F.filter(F.concat(*a[:2]), lambda v: v.isin(*a[2]))) >= a[3]
    elif form == "not":
        x = ~condition(a[0])
    else:
        x = condition(a[0])
        for y in a[1:]:
            x = (x & condition(y)) if form == "and" else (x | condition(y))
    return F.coalesce(x, F.lit(False))


def sql(c: tuple) -> str:
    """A condition as SQL with `regexp_matches`, `list_filter` and `list_has_any`."""
    form, *a = c
    q = lambda s: "'" + s.replace("'", "''") + "'"
    words = lambda ws: "[" + ", ".join(map(q, ws)) + "]"
    if form == "word":
        x = f"regexp_matches({a[0]}, {q(a[1])})"
    elif form == "some":
        x = f"len(list_filter({a[0]}, lambda v: regexp_matches(v, {q(a[1])}))) > 0"
    elif form == "some_both":
        x = f"len(list_filter({a[0]}, lambda v: regexp_matches(v, {q(a[1])}) AND regexp_matches(v, {q(a[2])}))) > 0"
    elif form == "has":
        x = f"list_contains({words(a[1])}, {a[0]})" if a[0] in ("kind", "name") else f"list_has_any({a[0]}, {words(a[1])})"
    elif form == "flag":
        x = a[0]
    elif form == "least":
        x = f"{a[0]} >= {a[1]}"
    elif form == "size":
        x = f"len({a[0]}) >= {a[1]}"
    elif form == "count":
        x = f"len(list_filter({a[0]}, lambda v: regexp_matches(v, {q(a[1])}))) >= {a[2]}"
    elif form == "more":
        x = f"{a[0]} > {a[1]}"
    elif form == "different":
        x = f"len(list_distinct({a[0]})) >= {a[1]}"
    elif form == "all_hidden":
        x = "len(properties) > 0 AND hidden_properties >= len(properties)"
    elif form == "at_least_of":
        x = f"len(list_filter({a[0]} || {a[1]}, lambda v: list_contains({words(a[2])}, v))) >= {a[3]}"
    elif form == "not":
        x = f"NOT {sql(a[0])}"
    else:
        x = f" {form.upper()} ".join(map(sql, a))
    return f"coalesce({x}, false)"


def worth(points) -> Column:
    """Points of a rule: a number, or (base, each, number column or (array, pattern), most)."""
    if not isinstance(points, tuple):
        return F.lit(float(points))
    base, each, of, most = points
    n = F.col(of) if isinstance(of, str) else F.size(F.filter(of[0], lambda v: v.rlike(of[1])))
    return F.least(F.lit(float(most)), base + n * each).cast("double")


def worth_sql(points) -> str:
    if not isinstance(points, tuple):
        return f"{float(points)}::DOUBLE"
    base, each, of, most = points
    n = of if isinstance(of, str) else f"len(list_filter({of[0]}, lambda v: regexp_matches(v, '{of[1]}')))"
    return f"least({float(most)}, {base} + {n} * {each})::DOUBLE"


def signals(candidates: DataFrame, keys: list[str], rules_of: dict | None = None) -> DataFrame:
    """(keys, pattern, rule, area, strength, points) of all rules that hold, penalties as area `penalty`, in one pass."""
    found = []
    for p, (kinds, rules, penalties) in (rules_of or RULES).items():
        row = lambda r, a, s, x, p=p: F.struct(F.lit(f"pattern.{p}").alias("pattern"), F.lit(r).alias("rule"), F.lit(a).alias("area"), F.lit(s).alias("strength"), worth(x).alias("points"))
        own = F.col("kind").isin(*kinds)
        found += [F.when(own & condition(c), row(r, (*area, "local")[0], s, x)) for r, x, s, c, *area in rules]
        found += [F.when(own & condition(c), row("penalty", "penalty", "none", x)) for x, c in penalties]
    d = candidates.select(*keys, F.array(*found).alias("_s"))
    # an outer explode: from an inner one Spark infers a filter that has all rules evaluated once more, outside of generated code
    return d.select(*keys, F.explode_outer("_s").alias("x")).where("x is not null").select(*keys, "x.*")


def signals_sql(rules_of: dict | None = None) -> str:
    """A list of the rules' structs, nulls where they don't hold."""
    found = []
    for p, (kinds, rules, penalties) in (rules_of or RULES).items():
        every = [(r, x, s, c, (*area, "local")[0]) for r, x, s, c, *area in rules] + [("penalty", x, "none", c, "penalty") for x, c in penalties]
        for r, x, s, c, area in every:
            found.append(f"CASE WHEN {sql(('has', 'kind', kinds))} AND {sql(c)} THEN {{'pattern': 'pattern.{p}', 'rule': '{r}', 'area': '{area}', 'strength': '{s}', 'points': {worth_sql(x)}}} END")
    return "[" + ", ".join(found) + "]"


def detect(candidates: DataFrame, keys: list[str], graph: DataFrame | None = None, level: str = "low") -> DataFrame:
    """Detections (keys, pattern, score, confidence, detected, rules, strong) of a level or higher.

    `graph` has more signals of the same columns, of area `graph` or `call`.
    """
    s = signals(candidates, keys)
    if graph is not None:
        s = s.unionByName(graph)
    return scoring.at_least(scoring.finish_additional(s, [*keys, "pattern"]).where("detected"), level)
