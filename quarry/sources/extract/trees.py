"""One entry for all languages: the tree of a source, and the node names that patterns may use."""

from __future__ import annotations

from ..tree import Tree
from . import blocks, markup, python

BUILDERS = {
    "python": python.tree, "json": markup.json_tree, "html": markup.html_tree, "css": markup.css_tree, "scss": lambda d: markup.css_tree(d, scss=True), "yaml": markup.yaml_tree,
    "markdown": markup.markdown_tree, "make": markup.make_tree, "bash": markup.bash_tree, "ruby": markup.ruby_tree, "sql": markup.sql_tree,
}
BUILDERS |= {name: (lambda d, name=name: blocks.Builder(name, d).tree()) for name in blocks.GRAMMARS}

VOCABULARY: dict[str, set[str]] = {
    "python": python.KINDS,
    "json": {"document", "object", "array", "pair", "string", "string_content", "number", "true", "false", "null"},
    "html": {"document", "element", "script_element", "style_element", "start_tag", "end_tag", "self_closing_tag", "tag_name", "attribute", "attribute_name", "attribute_value", "quoted_attribute_value", "raw_text", "comment", "doctype"},
    "css": {"stylesheet", "rule_set", "selectors", "class_name", "id_name", "tag_name", "keyframes_statement", "keyframes_name", "import_statement", "at_rule", "declaration", "property_name", "plain_value", "function_name"},
    "yaml": {"stream", "block_mapping_pair", "flow_node", "plain_scalar", "string_scalar", "single_quote_scalar", "double_quote_scalar", "flow_pair", "anchor", "anchor_name", "alias", "alias_name", "tag"},
    "markdown": {"document", "atx_heading", "setext_heading", "inline", "paragraph"},
    "make": {"makefile", "include_directive", "variable_assignment", "rule", "targets", "prerequisites", "word"},
    "bash": {"program", "function_definition", "variable_assignment", "variable_name", "word", "command", "command_name"},
    "ruby": {"program", "class", "module", "method", "singleton_method", "assignment", "call", "import_call", "identifier", "constant"},
    "sql": {"program", "identifier", "column_definition", "cte", *(k for k, _ in markup.SQL_CREATE)},
}
VOCABULARY["scss"] = VOCABULARY["css"] | {"mixin_statement", "function_statement", "placeholder", "identifier", "variable", "use_statement", "forward_statement"}
for _name, _g in blocks.GRAMMARS.items():
    VOCABULARY[_name] = (
        {"program", "call_expression", "method_invocation", "invocation_expression", "function_call_expression", "arguments", "string", "number", "assignment_expression", "variable_declarator", "declaration_item", "init_declaration", "init_declarator", "declaration", "function_signature_item", "trait_use_declaration", "property_promotion_parameter",
         "identifier", "type_identifier", "property_identifier", "field_identifier", "namespace_identifier", "namespace_name", "qualified_identifier", "preproc_include", "attribute_item", "method_declaration", "constructor_declaration",
         "property_declaration", "prototype_declaration", "generator_function_declaration", "abstract_class_declaration", "companion_object", "file_scoped_namespace_declaration", _g.leaf}
        | set(_g.words.values()) | set(_g.imports.values()) | set(_g.variables.values()) | set(_g.enum_entries.values()) | {x for x in (_g.method, _g.function, _g.prototype, _g.fields) if x}
    )


def tree_of(language: str, data: bytes) -> Tree:
    return BUILDERS[language](data)
