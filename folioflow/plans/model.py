"""The document format: fixed names and values, and the schemas of the tables it becomes."""

from __future__ import annotations

# Fixed values of the format.
FORMAT_VERSION = "0.5.0"
FORMAT_VERSION_KEY = "cnd_version"
DECLARATION_VERSION = "0.2.0"
NODE_TYPES = (
    "heading", "paragraph", "quote", "code", "math", "image",
    "figure", "admonition", "list", "terms", "table", "layout",
)
ATOMIC_MARKS = ("code", "math")
EDGE_FAMILIES = ("refs", "cites", "footnotes", "links")
DOC_FIELDS = ("title", "authors", "date", "keywords", "description", "lang", "status", "version", "extra")
BIB_FIELDS = ("type", "authors", "title", "year", "container", "doi", "url", "fields")
VERSION_RULE = "cnd-version-unsupported"
DECLARATION_RULE = "declaration-version-unsupported"
MATCH_PASSES = ("label", "hash+path", "hash", "path+type", "container-hash")

#: For each node type: the texts it owns, in order.
OWN_TEXTS = {
    "heading": ("text",),
    "paragraph": ("text",),
    "quote": ("attribution",),
    "figure": ("caption", "description"),
    "admonition": ("title",),
}
#: For each node type: required fields besides id and type.
REQUIRED = {
    "heading": ("level", "text", "heading_path"),
    "paragraph": ("text",),
    "code": ("text",),
    "math": ("text",),
    "admonition": ("kind",),
}

_MARK = "struct<start:int,end:int,kind:string,raw_format:string,raw_value:string>"
_EDGE = "struct<family:string,edge_index:int,label:string,href:string,span:array<int>,form:string,supplement:string>"
TEXT = f"struct<role:string,text_index:int,value:string,lang:string,marks:array<{_MARK}>,edges:array<{_EDGE}>>"
NODE = (
    "struct<scope:int,ord:array<int>,path:string,node_id:string,type:string,label:string,depth:int,"
    "parent_ord:array<int>,slot:string,slot_index:int,page:int,ctx_heading_path:array<string>,"
    "heading_path:array<string>,level:int,number:string,number_name:string,plain:string,lang:string,"
    "title:string,kind:string,image_path:string,alt:string,ordered:boolean,slots:int,node_hash:string,"
    f"texts:array<{TEXT}>>"
)
ENTRY = "struct<scope:int,ord:array<int>,entry:int,number:int,checked:boolean,row:int,col:int,rowspan:int,colspan:int,is_header:boolean>"
BIB = f"struct<pool_index:int,id:string,label:string,has_fields:boolean,formatted:{TEXT},shown:string,hash:string>"
NOTE = "struct<pool_index:int,id:string,label:string,hash:string>"
PARSED = (
    "doc_key string, id string, version string, built_at string, title string, doc_json string, extra_keys array<string>, "
    f"doc_fields_json string, nodes array<{NODE}>, entries array<{ENTRY}>, bibliography array<{BIB}>, footnotes array<{NOTE}>, raw string"
)
