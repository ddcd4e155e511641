"""Frameworks and what of them keeps code alive: entry-point annotations, modifiers, supertypes, receivers, model annotations.

Entry points are told by name, so an annotation of a framework that is not listed is none. Callers may add
presets of their own to PRESETS.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Annotations that change how a method runs but call nothing.
SPRING_MODIFIERS = (
    "org.springframework.transaction.annotation.Transactional",
    "org.springframework.cache.annotation.Cacheable",
    "org.springframework.cache.annotation.CacheEvict",
    "org.springframework.cache.annotation.CachePut",
    "org.springframework.scheduling.annotation.Async",
)
MICROPROFILE_MODIFIERS = (
    "org.eclipse.microprofile.faulttolerance.CircuitBreaker",
    "org.eclipse.microprofile.faulttolerance.Retry",
    "org.eclipse.microprofile.faulttolerance.Timeout",
    "org.eclipse.microprofile.faulttolerance.Bulkhead",
    "org.eclipse.microprofile.faulttolerance.Fallback",
    "org.eclipse.microprofile.faulttolerance.Asynchronous",
)
GRPC_MODIFIERS = (
    "io.smallrye.common.annotation.Blocking",
    "io.smallrye.common.annotation.NonBlocking",
    "io.smallrye.common.annotation.RunOnVirtualThread",
    "io.quarkus.grpc.RegisterInterceptor",
    "io.quarkus.grpc.RegisterClientInterceptor",
)
#: Supertypes whose implementors a framework calls, and receivers of functions that it calls.
KTOR_SUPERTYPES = (
    "io.ktor.server.auth.AuthenticationProvider",
    "io.ktor.server.application.BaseApplicationPlugin",
    "io.ktor.server.application.BaseRouteScopedPlugin",
    "io.ktor.serialization.ContentConverter",
    "io.ktor.server.html.Template",
    "com.nimbusds.jwt.proc.JWTClaimsSetVerifier",
    "com.nimbusds.jwt.proc.DefaultJWTClaimsVerifier",
)
KTOR_RECEIVERS = ("io.ktor.server.routing.Route", "io.ktor.server.application.Application")
PANACHE_SUPERTYPES = (
    "io.quarkus.hibernate.orm.panache.PanacheRepository",
    "io.quarkus.hibernate.orm.panache.PanacheRepositoryBase",
    "io.quarkus.hibernate.reactive.panache.PanacheRepository",
    "io.quarkus.hibernate.reactive.panache.PanacheRepositoryBase",
)
#: Annotations of classes that are data.
JPA_MODEL = (
    "jakarta.persistence.Entity",
    "jakarta.persistence.MappedSuperclass",
    "jakarta.persistence.Embeddable",
    "javax.persistence.Entity",
    "javax.persistence.MappedSuperclass",
    "javax.persistence.Embeddable",
)
MODIFIERS = SPRING_MODIFIERS + MICROPROFILE_MODIFIERS + GRPC_MODIFIERS

#: Annotations that mark entry points, by framework; of an annotation in two lists the first is its framework.
ENTRY_POINTS = {
    "spring": (
        "org.springframework.stereotype.Controller",
        "org.springframework.web.bind.annotation.RestController",
        "org.springframework.stereotype.Service",
        "org.springframework.stereotype.Component",
        "org.springframework.stereotype.Repository",
        "org.springframework.context.annotation.Configuration",
        "org.springframework.context.annotation.Bean",
        "org.springframework.scheduling.annotation.Scheduled",
        "org.springframework.context.event.EventListener",
        "org.springframework.web.bind.annotation.ExceptionHandler",
        "org.springframework.web.bind.annotation.ControllerAdvice",
        "org.springframework.boot.actuate.endpoint.annotation.Endpoint",
        "org.springframework.boot.autoconfigure.SpringBootApplication",
        "org.springframework.boot.autoconfigure.EnableAutoConfiguration",
        "org.springframework.context.annotation.ComponentScan",
        "org.springframework.web.bind.annotation.GetMapping",
        "org.springframework.web.bind.annotation.PostMapping",
        "org.springframework.web.bind.annotation.PutMapping",
        "org.springframework.web.bind.annotation.DeleteMapping",
        "org.springframework.web.bind.annotation.PatchMapping",
        "org.springframework.web.bind.annotation.RequestMapping",
        "org.springframework.web.bind.annotation.ModelAttribute",
        "org.springframework.web.bind.annotation.InitBinder",
        "org.springframework.web.bind.annotation.ResponseBody",
        "org.springframework.web.bind.annotation.RequestBody",
        "org.springframework.web.bind.annotation.PathVariable",
        "org.springframework.web.bind.annotation.RequestParam",
        "org.springframework.beans.factory.annotation.Autowired",
        "org.springframework.beans.factory.annotation.Value",
        "org.springframework.beans.factory.annotation.Qualifier",
        "org.springframework.context.annotation.Primary",
        "org.springframework.context.annotation.Lazy",
        "org.springframework.context.annotation.Scope",
        "org.springframework.context.annotation.Profile",
        "org.springframework.context.annotation.Conditional",
        "org.springframework.context.annotation.Import",
        "org.springframework.context.annotation.ImportResource",
        "org.springframework.context.annotation.PropertySource",
        "org.springframework.cache.annotation.EnableCaching",
    ),
    "jpa": (
        "jakarta.persistence.Entity",
        "jakarta.persistence.Table",
        "jakarta.persistence.MappedSuperclass",
        "jakarta.persistence.Embeddable",
        "jakarta.persistence.Converter",
        "jakarta.persistence.EntityListeners",
        "jakarta.persistence.Id",
        "jakarta.persistence.GeneratedValue",
        "jakarta.persistence.Column",
        "jakarta.persistence.JoinColumn",
        "jakarta.persistence.OneToMany",
        "jakarta.persistence.ManyToOne",
        "jakarta.persistence.OneToOne",
        "jakarta.persistence.ManyToMany",
        "jakarta.persistence.Transient",
        "jakarta.persistence.Enumerated",
        "jakarta.persistence.Temporal",
        "jakarta.persistence.Lob",
        "jakarta.persistence.NamedQuery",
        "jakarta.persistence.NamedQueries",
    ),
    "jackson": (
        "com.fasterxml.jackson.annotation.JsonCreator",
        "com.fasterxml.jackson.annotation.JsonProperty",
        "com.fasterxml.jackson.annotation.JsonIgnore",
        "com.fasterxml.jackson.annotation.JsonIgnoreProperties",
        "com.fasterxml.jackson.annotation.JsonFormat",
        "com.fasterxml.jackson.annotation.JsonValue",
        "com.fasterxml.jackson.annotation.JsonTypeInfo",
        "com.fasterxml.jackson.annotation.JsonSubTypes",
        "com.fasterxml.jackson.annotation.JsonTypeName",
        "com.fasterxml.jackson.annotation.JsonInclude",
        "com.fasterxml.jackson.annotation.JsonAlias",
        "com.fasterxml.jackson.annotation.JsonUnwrapped",
        "com.fasterxml.jackson.annotation.JsonRootName",
        "com.fasterxml.jackson.databind.annotation.JsonDeserialize",
        "com.fasterxml.jackson.databind.annotation.JsonSerialize",
    ),
    "jaxrs": (
        "jakarta.ws.rs.GET",
        "jakarta.ws.rs.POST",
        "jakarta.ws.rs.PUT",
        "jakarta.ws.rs.DELETE",
        "jakarta.ws.rs.PATCH",
        "jakarta.ws.rs.HEAD",
        "jakarta.ws.rs.OPTIONS",
        "jakarta.ws.rs.Path",
        "jakarta.ws.rs.Produces",
        "jakarta.ws.rs.Consumes",
        "jakarta.ws.rs.PathParam",
        "jakarta.ws.rs.QueryParam",
        "jakarta.ws.rs.HeaderParam",
        "jakarta.ws.rs.FormParam",
        "jakarta.ws.rs.BeanParam",
        "jakarta.ws.rs.CookieParam",
        "jakarta.ws.rs.DefaultValue",
        "jakarta.ws.rs.ext.Provider",
        "jakarta.ws.rs.NameBinding",
    ),
    "cdi": (
        "jakarta.enterprise.context.ApplicationScoped",
        "jakarta.enterprise.context.RequestScoped",
        "jakarta.enterprise.context.SessionScoped",
        "jakarta.enterprise.context.Dependent",
        "jakarta.enterprise.inject.Produces",
        "jakarta.enterprise.event.Observes",
        "jakarta.enterprise.event.ObservesAsync",
        "jakarta.enterprise.inject.Alternative",
        "jakarta.enterprise.inject.Disposes",
        "jakarta.interceptor.Interceptor",
        "jakarta.interceptor.AroundInvoke",
        "jakarta.interceptor.AroundConstruct",
        "jakarta.decorator.Decorator",
        "jakarta.decorator.Delegate",
    ),
    "microprofile": (
        "org.eclipse.microprofile.health.Liveness",
        "org.eclipse.microprofile.health.Readiness",
        "org.eclipse.microprofile.health.Startup",
        "org.eclipse.microprofile.rest.client.inject.RegisterRestClient",
        "org.eclipse.microprofile.rest.client.inject.RestClient",
        "org.eclipse.microprofile.config.inject.ConfigProperty",
        "org.eclipse.microprofile.openapi.annotations.Operation",
        "org.eclipse.microprofile.openapi.annotations.responses.APIResponse",
        "org.eclipse.microprofile.openapi.annotations.tags.Tag",
    ),
    "grpc": (
        "io.quarkus.grpc.GrpcService",
        "io.quarkus.grpc.GrpcClient",
        "io.quarkus.grpc.GlobalInterceptor",
        "net.devh.boot.grpc.server.service.GrpcService",
        "net.devh.boot.grpc.client.inject.GrpcClient",
        "net.devh.boot.grpc.client.inject.GrpcClientBean",
        "net.devh.boot.grpc.server.interceptor.GrpcGlobalServerInterceptor",
        "net.devh.boot.grpc.client.interceptor.GrpcGlobalClientInterceptor",
        "io.grpc.stub.annotations.GrpcGenerated",
    ),
    "jakarta": (
        "jakarta.annotation.PostConstruct",
        "jakarta.annotation.PreDestroy",
        "jakarta.inject.Inject",
        "jakarta.inject.Named",
        "jakarta.inject.Singleton",
        "jakarta.inject.Qualifier",
    ),
    "validation": (
        "jakarta.validation.Valid",
        "jakarta.validation.constraints.NotNull",
        "jakarta.validation.constraints.NotBlank",
        "jakarta.validation.constraints.NotEmpty",
        "jakarta.validation.constraints.Size",
        "jakarta.validation.constraints.Min",
        "jakarta.validation.constraints.Max",
        "jakarta.validation.constraints.Pattern",
        "jakarta.validation.constraints.Email",
        "jakarta.validation.constraints.Positive",
        "jakarta.validation.constraints.PositiveOrZero",
        "jakarta.validation.constraints.Negative",
        "jakarta.validation.constraints.NegativeOrZero",
        "jakarta.validation.constraints.Past",
        "jakarta.validation.constraints.PastOrPresent",
        "jakarta.validation.constraints.Future",
        "jakarta.validation.constraints.FutureOrPresent",
        "jakarta.validation.constraints.Digits",
        "jakarta.validation.constraints.DecimalMin",
        "jakarta.validation.constraints.DecimalMax",
        "jakarta.validation.constraints.AssertTrue",
        "jakarta.validation.constraints.AssertFalse",
        "jakarta.validation.constraints.Null",
        "org.hibernate.validator.constraints.Length",
        "org.hibernate.validator.constraints.Range",
        "org.hibernate.validator.constraints.URL",
        "org.hibernate.validator.constraints.CreditCardNumber",
    ),
    "junit": (
        "org.junit.jupiter.api.Test",
        "org.junit.jupiter.api.BeforeEach",
        "org.junit.jupiter.api.AfterEach",
        "org.junit.jupiter.api.BeforeAll",
        "org.junit.jupiter.api.AfterAll",
        "org.junit.jupiter.params.ParameterizedTest",
        "org.junit.jupiter.api.RepeatedTest",
        "org.junit.jupiter.api.TestFactory",
        "org.junit.jupiter.api.Disabled",
        "org.junit.jupiter.api.extension.ExtendWith",
        "org.junit.jupiter.api.Tag",
        "org.junit.jupiter.api.Nested",
        "org.junit.jupiter.api.DisplayName",
    ),
    "quarkus": (
        "io.quarkus.scheduler.Scheduled",
        "io.quarkus.vertx.ConsumeEvent",
        "io.quarkus.runtime.Startup",
    ),
}
MODIFIERS_OF = {"microprofile": MICROPROFILE_MODIFIERS, "grpc": GRPC_MODIFIERS, "spring": SPRING_MODIFIERS}
#: Supertypes of Spring Data.
SPRING_SUPERTYPES = (
    "org.springframework.data.repository.Repository",
    "org.springframework.data.repository.CrudRepository",
    "org.springframework.data.repository.ListCrudRepository",
    "org.springframework.data.jpa.repository.JpaRepository",
    "org.springframework.data.repository.PagingAndSortingRepository",
    "org.springframework.data.repository.ListPagingAndSortingRepository",
    "org.springframework.data.repository.reactive.ReactiveCrudRepository",
    "org.springframework.data.repository.reactive.ReactiveSortingRepository",
    "org.springframework.data.mongodb.repository.MongoRepository",
    "org.springframework.data.mongodb.repository.ReactiveMongoRepository",
    "org.springframework.data.elasticsearch.repository.ElasticsearchRepository",
    "org.springframework.data.redis.repository.RedisRepository",
)


@dataclass(frozen=True)
class Preset:
    """frameworks: those whose annotations are entry points."""

    frameworks: tuple[str, ...] = ()
    supertypes: tuple[str, ...] = ()
    receivers: tuple[str, ...] = ()
    models: tuple[str, ...] = ()


#: What each preset holds.
PRESETS = {
    "spring": Preset(("spring", "jpa", "jakarta", "validation", "grpc"), SPRING_SUPERTYPES, models=JPA_MODEL),
    "quarkus": Preset(("quarkus", "jaxrs", "cdi", "microprofile", "jpa", "jakarta", "validation", "jackson", "grpc"), PANACHE_SUPERTYPES, models=JPA_MODEL),
    "grpc": Preset(("grpc",)),
    "jaxrs": Preset(("jaxrs",)),
    "cdi": Preset(("cdi",)),
    "microprofile": Preset(("microprofile",)),
    "jpa": Preset(("jpa",), models=JPA_MODEL),
    "jackson": Preset(("jackson",)),
    "jakarta": Preset(("jakarta",)),
    "validation": Preset(("validation",)),
    "junit": Preset(("junit",)),
    "ktor": Preset((), KTOR_SUPERTYPES, receivers=KTOR_RECEIVERS),
}


def presets_but(dead: Iterable[str] = ()) -> list[Preset]:
    """Presets in force: all but those named (in any case); ALL leaves none. What another preset holds too stays."""
    names = {x.lower() for x in dead}
    return [] if "all" in names else [p for n, p in PRESETS.items() if n not in names]


def framework_of(annotation: Column) -> Column:
    """Name of the framework an annotation belongs to; null for others."""
    out = F
    for name, listed in ENTRY_POINTS.items():
        out = out.when(annotation.isin(*listed, *MODIFIERS_OF.get(name, ())), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def is_modifier(annotation: Column) -> Column:
    return annotation.isin(*MODIFIERS)


def is_entry_point(annotation: Column, dead: Iterable[str] = ()) -> Column:
    """An annotation that a preset in force lists as an entry point; modifiers are none."""
    names = sorted({a for p in presets_but(dead) for f in p.frameworks for a in ENTRY_POINTS[f]})
    return F.coalesce(annotation.isin(names), F.lit(False)) if names else F.lit(False)


def is_entry_supertype(supertype: Column, dead: Iterable[str] = ()) -> Column:
    names = sorted({x for p in presets_but(dead) for x in p.supertypes})
    return supertype.isin(names) if names else F.lit(False)


def is_entry_receiver(receiver: Column, dead: Iterable[str] = ()) -> Column:
    names = sorted({x for p in presets_but(dead) for x in p.receivers})
    return receiver.isin(names) if names else F.lit(False)


def annotation_tags(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """nodes (class, method, ...) with tags: sorted (annotation, framework) of the method, or of its class where it has none.

    notes (class, method null for the class, annotation).
    """
    tags = lambda df, *by: df.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("annotation", framework_of(F.col("annotation")).alias("framework")))).alias("tags"))
    of_method = tags(notes.filter("method is not null"), "class", "method").withColumnRenamed("tags", "own")
    of_class = tags(notes.filter("method is null"), "class").withColumnRenamed("tags", "outer_tags")
    return nodes.join(of_method, ["class", "method"], "left").join(of_class, "class", "left").withColumn("tags", F.coalesce("own", "outer_tags")).select(*nodes.columns, "tags")


def entry_point_hints(roots: DataFrame, notes: DataFrame) -> DataFrame:
    """(class, method, hint) of roots of caller trees that a framework calls, from their first annotation by name that is a framework's."""
    tagged = annotation_tags(roots.select("class", "method").distinct(), notes)
    first = F.element_at(F.filter("tags", lambda t: t["framework"].isNotNull()), 1)
    simple = F.substring_index(F.col("t.annotation"), ".", -1)
    hint = F.concat(F.lit("@"), simple, F.lit(" is a "), F.col("t.framework"), F.lit(" entry point; invoked by the framework at runtime."))
    return tagged.filter(F.exists("tags", lambda t: t["framework"].isNotNull())).withColumn("t", first).select("class", "method", hint.alias("hint"))
