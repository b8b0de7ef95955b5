"""Relations that the extraction gives, one schema each."""

RELATIONS = {
    "functions": "fn_id string, name string, signature string, file_path string, start_line int, end_line int, is_async boolean, is_unsafe boolean, is_pub boolean, is_const boolean, is_test boolean, generics array<string>, parameters array<string>, return_type string, kind string, kind_tag string, owner_type string, cfg_attrs array<string>, module_path array<string>, attributes array<string>, ordinal int",
    "types": "symbol_id string, symbol_kind string, name string, signature string, file_path string, start_line int, end_line int, is_pub boolean, generics array<string>, fields array<string>, variants array<struct<name:string,fields:array<string>,discriminant:string>>, ty string, rhs string, kind string, cfg_attrs array<string>",
    "call_sites": "caller_id string, caller_name string, callee string, callee_base string, call_kind string, file_path string, line int, column int, args array<string>",
    "aliases": "alias string, target string, file_path string, full_path string",
    "reexports": "containing_module array<string>, local_name string, target_path string",
    "occurrences": "file_path string, line int, col int, ident string, qualifier string, kind string, fn_id string",
    "impls": "type_name string, trait_path string, trait_name string, impl_kind string, file_path string, line int",
    "flow": "fn_id string, fact string, what string, file_path string, line int, col int",
    "string_sites": "site_id string, role string, name string, ty string, owner string, owner_name string, position int, file_path string, line int, is_test boolean",
    "literals": "fn_id string, file_path string, line int, col int, literal string, before string, after string",
}
EXTRACTED = "relation string, payload string"
FILES = "file_path string, content string"
