"""Declared schemas of the collections. Nothing is inferred; secrets are never part of a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_BINDING = "struct<repo_full_name:string,path:string,branch:string,commit_sha:string,signature_hash:string>"
_MEMBER = "struct<user_id:string,login:string,avatar_url:string,role:string,added_at:timestamp>"

DDL = {
    "users": "user_id string, full_name string, email string, github_id string, github_login string, avatar_url string, "
             "created_at timestamp, updated_at timestamp",
    "projects": "project_id string, owner_id string, project_name string, description string, repo_full_name string, "
                f"members array<{_MEMBER}>, created_at timestamp, updated_at timestamp",
    "documents": "doc_id string, project_id string, title string, content string, format string, current_version int, "
                 f"source_repo string, source_bindings array<{_BINDING}>, generated_at timestamp, created_at timestamp, updated_at timestamp",
    "doc_versions": "version_id string, doc_id string, version_no int, commit_hash string, content string, message string, source string, "
                    "author_id string, author_login string, author_avatar_url string, external_commit_sha string, external_commit_url string, "
                    "created_at timestamp",
    "notes": "note_id string, project_id string, content string, created_at timestamp",
    "source_files": "file_id string, project_id string, file_name string, file_type string, file_content string, created_at timestamp",
    "feedback": "doc_id string, user_id string, rating int, comment string, at timestamp",
    "repos": "id bigint, name string, full_name string, description string, language string, default_branch string, "
             "updated_at timestamp, private boolean, stargazers int",
    "repo_tree": "path string, type string",
    "repo_snapshot": "repo_full_name string, path string, branch string, blob_sha string, encoding string, content string",
    "blobs": "repo_full_name string, blob_sha string, encoding string, content string",
}
MANIFEST_DDL = (f"array<struct<doc_path:string,sources:array<{_BINDING}>,generated_at:string,generator:string,author_login:string,version:int>>")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
