"""Row schemas: nodes of an indexing pipeline, queries, documents, messages."""

from __future__ import annotations

NODE = (
    "id string, path string, chunk string, metadata map<string,string>, vectors map<string,array<float>>, "
    "sparse_vectors map<string,struct<indices:array<int>,values:array<float>>>, embed_mode string, original_size bigint, offset bigint, error string"
)
DOCUMENT = "struct<content:string,metadata:map<string,string>>"
EVENT = f"struct<kind:string,before:string,after:string,documents:array<{DOCUMENT}>>"
QUERY = (
    "qid bigint, original string, current string, state string, embedding array<float>, "
    f"sparse_embedding struct<indices:array<int>,values:array<float>>, documents array<{DOCUMENT}>, history array<{EVENT}>"
)
MESSAGE = "conv_id bigint, turn bigint, role string, text string, tool_calls array<struct<id:string,name:string,args:string>>"

#: How a node's text and metadata become texts to embed.
SINGLE, PER_FIELD, BOTH = "SingleWithMetadata", "PerField", "Both"
EMBED_MODES = (SINGLE, PER_FIELD, BOTH)
COMBINED, CHUNK = "Combined", "Chunk"


def metadata_field(name: str) -> str:
    """The display name of a metadata key's embedding."""
    return f"Metadata: {name}"
