"""Detectors over candidates: one kind of code for each part, by its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from graphloom.plans import architecture, detectors
from graphloom.session import table

_CODE: list[dict] = [
    {"kind": "class", "name": "OrderController", "text": "class OrderController { @Get() list(req, res) { res.json([]) } }", "decorators": ["Controller"], "method_decorators": ["Get"], "member_decorators": ["Get"], "methods": ["list"], "calls": ["json"], "constructor_types": ["OrderService"], "injected": True, "boundary": True, "terminates": True},
    {"kind": "class", "name": "PlainController", "text": "class PlainController { }"},
    {"kind": "call", "name": "get", "text": "app.get('/x', (req, res) => res.send(1))", "calls": ["get", "send"], "registers": True, "callbacks": 1, "callback_boundary": True, "callback_terminates": True},
    {"kind": "arrow", "name": "saveHandler", "text": "(req, res) => { if (!req.body) throw new ValidationError(); return res.json({}) }", "boundary": True, "terminates": True, "inline_route": True, "throws": 1, "calls": ["json"]},
    {"kind": "class", "name": "RoleGuard", "text": "class RoleGuard implements CanActivate { canActivate(c) { return c.user.role === 'admin' } }", "interfaces": ["CanActivate"], "methods": ["canActivate"], "decorators": ["Injectable"], "boolean_return": True, "injected": True},
    {"kind": "class", "name": "LogInterceptor", "text": "class LogInterceptor { intercept(c, next) { return next.handle().pipe(tap(log)) } }", "methods": ["intercept"], "entry_text": "intercept(c, next) { return next.handle().pipe(tap(log)) }", "calls": ["handle", "pipe", "tap"]},
    {"kind": "class", "name": "CreateUserDto", "text": "class CreateUserDto { @IsEmail() readonly mail: string; @Length(3) name: string }", "member_decorators": ["IsEmail", "Length"], "property_decorators": ["IsEmail", "Length"], "properties": ["mail", "name"], "hidden_properties": 1, "data_shape": True, "imports": ["class-validator"]},
    {"kind": "class", "name": "UserEntity", "text": "class UserEntity { @PrimaryColumn() id; @Column() name }", "file_text": "import { Entity } from 'typeorm'", "decorators": ["Entity"], "property_decorators": ["PrimaryColumn", "Column"], "member_decorators": ["PrimaryColumn", "Column"], "properties": ["id", "name"], "data_shape": True},
    {"kind": "class", "name": "Money", "text": "class Money { private readonly amount; constructor(a) { if (a < 0) throw new Error('Invalid') } equals(o) { return o.amount === this.amount } }", "properties": ["amount"], "hidden_properties": 1, "methods": ["equals"], "constructors": ["constructor(a) { if (a < 0) throw new Error('Invalid') }"], "throws": 1},
    {"kind": "class", "name": "PlaceOrderUseCase", "text": "class PlaceOrderUseCase { execute(input) { this.repo.save(input); this.bus.send(input) } }", "methods": ["execute"], "constructor_types": ["OrderRepository", "EventBus"], "injected": True, "entry_boundary": True, "entry_calls": 2, "calls": ["save", "send"]},
    {"kind": "class", "name": "OrderPresenter", "text": "class OrderPresenter { present(order) { return { rows: order.lines.map(toView) } } }", "methods": ["present"], "signatures": ["(order: Order): OrderViewModel", "(r: DomainResult): OrderDto"], "transforms": 1, "calls": ["map"]},
    {"kind": "class", "name": "UserResolver", "text": "@Resolver() class UserResolver { @Query() users(@Args() a) { } }", "decorators": ["Resolver"], "method_decorators": ["Query"], "parameter_decorators": ["Args"], "member_decorators": ["Query", "Args"], "methods": ["users"], "imports": ["@nestjs/graphql"], "injected": True},
    {"kind": "object", "name": "", "text": "{ provide: TOKEN, useFactory: make, inject: [Config] }", "keys": ["provide", "useFactory", "inject"]},
    {"kind": "call", "name": "register", "text": "container.register('db', { useClass: Db })", "arguments": "'db', { useClass: Db }", "calls": ["register"]},
    {"kind": "function", "name": "bootstrap", "text": "function bootstrap() { const app = express(); new Db(process.env.URL); new Cache(); new Queue(); app.listen(1) }", "file_path": "src/main.ts", "news": 3, "calls": ["express", "listen"]},
    {"kind": "class", "name": "PageCache", "text": "class PageCache { m = new Map(); get(k) { if (this.m.has(k)) return this.m.get(k); this.m.set(k, { ttl: Date.now() }) } }", "methods": ["get"], "calls": ["has", "get", "set", "now"], "properties": ["m"]},
    {"kind": "function", "name": "withRetry", "text": "async function withRetry(f, maxAttempts) { for (let attempt = 0; ; attempt++) { try { return await f() } catch (e) { await sleep(backoff(attempt)) } } }", "loops": 1, "tries": 1, "calls": ["f", "sleep", "backoff"]},
    {"kind": "class", "name": "CircuitBreaker", "text": "class CircuitBreaker { state = 'closed'; call(f) { if (this.state === 'open') { throw new CircuitOpen() } try { return f() } catch (e) { this.failures++; this.nextAttempt = Date.now() } } }", "methods": ["call"], "tries": 1, "throws": 1, "calls": ["f", "now"], "properties": ["state"]},
    {"kind": "class", "name": "MailWorker", "text": "class MailWorker { @Process() handle(job) { this.send(job.data); job.ack() } }", "decorators": ["Processor"], "method_decorators": ["Process"], "member_decorators": ["Process"], "methods": ["handle"], "imports": ["bull"], "calls": ["send", "ack", "on"]},
    {"kind": "class", "name": "ReportJob", "text": "class ReportJob { @Cron('0 * * * *') run() { this.service.report() } }", "member_decorators": ["Cron"], "method_decorators": ["Cron"], "methods": ["run"], "imports": ["@nestjs/schedule"], "injected": True, "calls": ["report"], "entry_calls": 1},
    {"kind": "function", "name": "newFlow", "text": "function newFlow(u) { if (flags.isEnabled('checkout-flag', u)) { a() } else { b() } }", "imports": ["unleash-client"], "calls": ["isEnabled", "a", "b"]},
    {"kind": "class", "name": "PaidSpecification", "text": "class PaidSpecification { isSatisfiedBy(item) { return item.paid === true && item.total > 0 } and(o) { } }", "methods": ["isSatisfiedBy", "and"], "boolean_return": True},
    {"kind": "interface", "name": "ListQuery", "text": "interface ListQuery { readonly page: number }", "data_shape": True, "properties": ["page"]},
]


_DESIGN: list[dict] = [
    {"kind": "class", "name": "Settings", "text": "class Settings { private static instance: Settings; private constructor() { } static getInstance() { return this.instance } }", "restricted_constructor": True, "static_instances": 1, "static_accessors": 1, "methods": ["getInstance"]},
    {"kind": "class", "name": "OpenSettings", "text": "class OpenSettings { static instance = new OpenSettings() }", "static_instances": 1, "news": 1},
    {"kind": "class", "name": "OrderService", "text": "class OrderService { constructor(private repo: OrderRepository, private bus: EventBus, private mail: MailClient) { } place(o) { this.repo.save(o); this.bus.publish(o) } }", "decorators": ["Injectable"], "constructor_types": ["OrderRepository", "EventBus", "MailClient"], "dependencies": 3, "parameter_properties": True, "uses_dependency": True, "orchestrators": 1, "short_orchestrators": 1, "dependency_properties": 3, "dependency_calls": 2, "call_texts": ["this.repo.save(o)", "this.bus.publish(o)"], "methods": ["place"]},
    {"kind": "function", "name": "createShape", "text": "function createShape(k): Shape { if (k) return new Circle(); return new Square() }", "news": 2, "returned_classes": ["Circle", "Square"], "branches": 1, "abstract_return": True},
    {"kind": "class", "name": "Feed", "text": "class Feed { listeners = []; subscribe(f) { } notify(x) { this.listeners.forEach((f) => f(x)) } }", "methods": ["subscribe", "notify"], "listener_types": ["any[]"], "notify_loops": True, "properties": ["listeners"], "call_texts": ["this.listeners.forEach((f) => f(x))"]},
    {"kind": "interface", "name": "PricingStrategy", "text": "interface PricingStrategy { price(): number }", "implementations": 3},
    {"kind": "class", "name": "SqlUserRepository", "text": "class SqlUserRepository implements UserRepository { constructor(private db: Database) { } findById() { } save() { } deleteAll() { } }", "interfaces": ["UserRepository"], "methods": ["findById", "save", "deleteAll"], "constructor_types": ["Database"], "dependencies": 1, "properties": ["db"]},
    {"kind": "class", "name": "QueryBuilder", "text": "class QueryBuilder { build() { return new Query(this.parts) } }", "chainable": 4, "terminal": True, "terminal_news": 1, "news": 1, "properties": ["parts", "limit"], "methods": ["where", "build"]},
    {"kind": "class", "name": "StripeAdapter", "text": "class StripeAdapter implements Payments { pay() { return this.client.charge().then(toPayment) } }", "interfaces": ["Payments"], "dependency_properties": 1, "properties": ["client"], "call_texts": ["this.client.charge()"], "converts": True},
    {"kind": "class", "name": "ShopFacade", "text": "class ShopFacade { buy() { this.cart.close(); this.bank.pay() } }", "dependency_properties": 2, "dependencies": 2, "short_orchestrators": 1, "orchestrators": 1},
    {"kind": "class", "name": "LoggingDecorator", "text": "class LoggingDecorator implements Store { get(k) { log('before'); return this.inner.get(k) } }", "interfaces": ["Store"], "wrapped_parameters": 1, "dependencies": 1, "call_texts": ["this.inner.get(k)"], "method_texts": ["get(k) { log('before'); return this.inner.get(k) }"], "methods": ["get"]},
    {"kind": "class", "name": "RemoteProxy", "text": "class RemoteProxy implements Api { call() { if (this.cache) return this.cache.get(); return this.target.call() } }", "interfaces": ["Api"], "dependencies": 1, "branches": 1, "call_texts": ["this.cache.get()", "this.target.call()"]},
    {"kind": "class", "name": "RenameCommand", "text": "class RenameCommand { execute() { this.bus.dispatch() } undo() { } }", "methods": ["execute", "undo"], "properties": ["name"]},
    {"kind": "object", "name": "", "text": "{ execute: () => queue.push(1) }"},
    {"kind": "function", "name": "authMiddleware", "text": "function authMiddleware(req, res, next) { next() }", "parameters": ["req", "res", "next"]},
    {"kind": "class", "name": "Bus", "text": "class Bus extends EventEmitter { on() { } emit(k) { for (const f of this.handlers[k]) f() } }", "base_class": "EventEmitter", "methods": ["on", "emit"], "listener_types": ["Record<string, Function[]>"], "emit_loops": True, "properties": ["handlers"]},
    {"kind": "class", "name": "ServiceRegistry", "text": "class ServiceRegistry { items = new Map(); register(k, v) { this.items.set(k, v) } get(k) { return this.items.get(k) } }", "methods": ["register", "get"], "properties": ["items"], "property_types": ["Map<string, object>"], "news": 1},
    {"kind": "class", "name": "PluginHost", "text": "class PluginHost { load(p) { return import(p) } plugins = [] }", "methods": ["load"], "properties": ["plugins"]},
    {"kind": "function", "name": "toOrderDto", "text": "function toOrderDto(o) { return { id: o.id, lines: o.lines.map(line) } }", "converts": True, "object_transform": True, "array_calls": ["o.lines.map(line)"]},
    {"kind": "file", "name": "index.ts", "base_name": "index.ts", "text": "export * from './a'; export { b } from './b'", "exports": 6, "star_exports": 1, "exported_names": 9},
    {"kind": "class", "name": "SqlUnitOfWork", "text": "class SqlUnitOfWork { async run(a: UserRepository, b: OrderRepository) { try { await this.tx.commit() } catch (e) { await this.tx.rollback() } } }", "dependency_calls": 2},
    {"kind": "class", "name": "Thing", "text": "class Thing { }"},
    {"kind": "class", "name": "LonelyAdapter", "text": "class LonelyAdapter { }", "outer_news": 2},
]


def _value(field, row: dict):
    default = [] if isinstance(field.dataType, ArrayType) else False if isinstance(field.dataType, BooleanType) else 0 if isinstance(field.dataType, IntegerType) else ""
    return row.get(field.name, default)


def candidates(spark: SparkSession, d: str, code: list[dict] = _CODE, features: str = detectors.FEATURES) -> DataFrame:
    s = StructType.fromDDL(f"n int, {features}")
    rows = spark.createDataFrame([(n, *[_value(f, row) for f in s.fields[1:]]) for n, row in enumerate(code)], s)
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(code)).cast("int").alias("n"))
    # a file of bare keys is one task; a fixed number of parts, as Spark would coalesce them by the keys' size, not the work
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    # the name of every hundredth part's code ends in another way
    return p.join(F.broadcast(rows), "n").withColumn("name", F.when(F.col("p_partkey") % 100 == 0, F.concat("name", F.lit("Handler"))).otherwise(F.col("name"))).drop("n")


def detected_patterns(spark: SparkSession, d: str) -> DataFrame:
    return detectors.detect(candidates(spark, d), ["p_partkey"]).select("p_partkey", "pattern", "score", "confidence", F.col("strong").cast("long").alias("strong"))


def pattern_signals(spark: SparkSession, d: str) -> DataFrame:
    return detectors.signals(candidates(spark, d), ["p_partkey"])


def _designs(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d, _DESIGN, architecture.FEATURES)


def detected_designs(spark: SparkSession, d: str) -> DataFrame:
    return architecture.detect(_designs(spark, d), ["p_partkey"]).select("p_partkey", "pattern", "score", "confidence")


def design_signals(spark: SparkSession, d: str) -> DataFrame:
    return detectors.signals(_designs(spark, d), ["p_partkey"], architecture.RULES)


QUERIES = {f.__name__: f for f in (detected_patterns, pattern_signals, detected_designs, design_signals)}


def _literal(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]::VARCHAR[]"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x).lower()


def _sql(code: list[dict], features: str, rules: dict) -> str:
    fields = [f.split() for f in features.split(", ")]
    kinds = {"string": "", "int": 0, "boolean": False, "array<string>": []}
    rows = ", ".join("(" + ", ".join([str(n), *[_literal(row.get(a, kinds[t])) for a, t in fields]]) + ")" for n, row in enumerate(code))
    return f"""WITH code AS (SELECT * FROM (VALUES {rows}) v(n, {", ".join(a for a, _ in fields)})),
        c AS (SELECT p_partkey, code.* REPLACE (CASE WHEN p_partkey % 100 = 0 THEN name || 'Handler' ELSE name END AS name) FROM part JOIN code ON n = p_partkey % {len(code)}),
        s AS (SELECT p_partkey, unnest(list_filter({detectors.signals_sql(rules)}, lambda x: x IS NOT NULL)) AS x FROM c), g AS (SELECT p_partkey, x.* FROM s)"""


_PATTERNS, _DESIGNS = _sql(_CODE, detectors.FEATURES, detectors.RULES), _sql(_DESIGN, architecture.FEATURES, architecture.RULES)
_LEVEL = "CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence"
ORACLE_SQL = {
    "pattern_signals": _PATTERNS + " SELECT p_partkey, pattern, rule, area, strength, points FROM g",
    "design_signals": _DESIGNS + " SELECT p_partkey, pattern, rule, area, strength, points FROM g",
    "detected_patterns": _PATTERNS
    + f""", t AS (SELECT p_partkey, pattern, coalesce(sum(points) FILTER (area <> 'penalty'), 0) - coalesce(sum(points) FILTER (area = 'penalty'), 0) AS raw,
          count(*) FILTER (area <> 'penalty') AS rules, count(*) FILTER (strength = 'strong') AS strong, bool_and(contains(rule, 'name') OR area = 'penalty') AS names FROM g GROUP BY ALL),
        u AS (SELECT *, CASE WHEN rules > 0 AND names THEN least(raw, 3.9) ELSE raw END AS a FROM t),
        f AS (SELECT *, floor(greatest(CASE WHEN strong = 0 AND a >= 7 THEN 6.9 ELSE a END, 0) * 10 + 0.5)::DOUBLE / 10 AS score FROM u)
        SELECT p_partkey, pattern, score, {_LEVEL}, strong FROM f WHERE score >= 1""",
    "detected_designs": _DESIGNS
    + f""", t AS (SELECT p_partkey, pattern, coalesce(sum(points) FILTER (area = 'local'), 0) AS loc, coalesce(sum(points) FILTER (area = 'type'), 0) AS typ, coalesce(sum(points) FILTER (area = 'penalty'), 0) AS pen,
          coalesce(bool_or(NOT regexp_matches(rule, '(?i)name|suffix|decorator')) FILTER (area <> 'penalty'), false) AS other FROM g GROUP BY ALL),
        u AS (SELECT *, CASE WHEN loc + typ < 2 AND loc + typ - pen >= 7 THEN 4 ELSE loc + typ - pen END AS a FROM t),
        f AS (SELECT *, floor(CASE WHEN loc > 0 AND NOT other AND typ = 0 THEN least(a, 3.75) ELSE a END * 100 + 0.5)::DOUBLE / 100 AS score FROM u)
        SELECT p_partkey, pattern, score, {_LEVEL} FROM f WHERE score >= 1""",
}
