"""Graphs as GEXF: typed node and edge attributes, missing values filled by type."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame

TYPES = {"long": "long", "integer": "integer", "double": "double", "float": "double", "boolean": "boolean"}
DEFAULTS = {"long": 0, "integer": 0, "double": 0.0, "boolean": False, "string": ""}


def write(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = True) -> None:
    """nodes(node, ...) and edges(src, dst, ...) as a GEXF file on the driver's machine.

    The format is one file; rows stream into it a partition at a time, so the driver holds no more than one."""

    def attributes(df: DataFrame, kind: str, skip: tuple[str, ...]):
        fields = [(f.name, TYPES.get(f.dataType.typeName(), "string")) for f in df.schema.fields if f.name not in skip]
        head = f'<attributes class="{kind}">' + "".join(f"<attribute id={quoteattr(n)} title={quoteattr(n)} type={quoteattr(t)}/>" for n, t in fields) + "</attributes>\n"
        return fields, head

    def values(row, fields) -> str:
        out = []
        for n, t in fields:
            v = row[n]
            v = DEFAULTS[t] if v is None or v != v else v
            out.append(f"<attvalue for={quoteattr(n)} value={quoteattr(str(v).lower() if t == 'boolean' else str(v))}/>")
        return f"<attvalues>{''.join(out)}</attvalues>"

    nf, nh = attributes(nodes, "node", ("node",))
    ef, eh = attributes(edges, "edge", ("src", "dst"))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="{"directed" if directed else "undirected"}">\n{nh}{eh}<nodes>\n')
        for r in nodes.toLocalIterator():
            f.write(f"<node id={quoteattr(str(r['node']))} label={quoteattr(str(r['node']))}>{values(r, nf)}</node>\n")
        f.write("</nodes>\n<edges>\n")
        for i, r in enumerate(edges.toLocalIterator()):
            f.write(f'<edge id="{i}" source={quoteattr(str(r["src"]))} target={quoteattr(str(r["dst"]))}>{values(r, ef)}</edge>\n')
        f.write("</edges>\n</graph></gexf>\n")
