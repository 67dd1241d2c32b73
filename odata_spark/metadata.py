"""Service document and CSDL."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import types as T

from .edm import Nav, Registry, edm_type


def service_document(registry: Registry) -> dict:
    return {"@odata.context": f"{registry.options.root}/$metadata", "value": [{"name": s, "url": s, "kind": "EntitySet"} for s in registry.sets]}


def csdl(registry: Registry) -> str:
    ns, out = registry.options.namespace, []
    for spec in registry.types.values():
        out.append(f"<EntityType Name={quoteattr(spec.name)}>")
        out.append("<Key>" + "".join(f"<PropertyRef Name={quoteattr(k)}/>" for k in spec.key) + "</Key>")
        for name, kind in registry.properties(spec).items():
            facets = ""
            override = spec.overrides.get(name, "")
            if isinstance(kind, T.DecimalType):
                facets = f' Precision="{kind.precision}" Scale="{kind.scale}"'
            elif override.startswith("Edm.String(") or override.startswith("Edm.Binary("):
                facets = f' MaxLength="{override[11:-1]}"'
            null = ' Nullable="false"' if name in spec.key else ""
            note = '<Annotation Term="Org.OData.Core.V1.Computed" Bool="true"/>' if name in spec.computed else ""
            out.append(f'<Property Name={quoteattr(name)} Type="{edm_type(kind, override)}"{facets}{null}' + (f">{note}</Property>" if note else "/>"))
        for nav in spec.navs:
            out.append(_nav(nav, ns))
        out.append("</EntityType>")
    out.append('<EntityContainer Name="Container">')
    for set_name, spec in registry.sets.items():
        out.append(f'<EntitySet Name={quoteattr(set_name)} EntityType="{ns}.{spec.name}">')
        for nav in spec.navs:
            if nav.target in registry.types:
                out.append(f'<NavigationPropertyBinding Path={quoteattr(nav.name)} Target="{registry.types[nav.target].set}"/>')
        if isinstance(spec.etag, str):
            out.append(f'<Annotation Term="Org.OData.Core.V1.OptimisticConcurrency"><Collection><PropertyPath>{spec.etag}</PropertyPath></Collection></Annotation>')
        out.append("</EntitySet>")
    body = "".join(out)
    return (
        '<?xml version="1.0" encoding="UTF-8"?><edmx:Edmx xmlns:edmx="http://docs.oasis-open.org/odata/ns/edmx" Version="4.0"><edmx:DataServices>'
        f'<Schema xmlns="http://docs.oasis-open.org/odata/ns/edm" Namespace="{ns}">{body}</EntityContainer></Schema></edmx:DataServices></edmx:Edmx>'
    )


def _nav(nav: Nav, ns: str) -> str:
    kind = f"Collection({ns}.{nav.target})" if nav.many else f"{ns}.{nav.target}"
    null = "" if nav.many or nav.nullable else ' Nullable="false"'
    partner = f' Partner="{nav.partner}"' if nav.partner else ""
    links = "" if nav.many else "".join(f'<ReferentialConstraint Property="{a}" ReferencedProperty="{b}"/>' for a, b in nav.on)
    return f'<NavigationProperty Name="{nav.name}" Type="{kind}"{null}{partner}' + (f">{links}</NavigationProperty>" if links else "/>")
