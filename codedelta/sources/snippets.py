"""A 24-row literal table of code snippets in five languages.

Documents in the driver tables are prose, so code pairs are derived by
appending a snippet to each document (``doc_id % 24``).  Together the
snippets hit every refactoring rule text, every risk category, the
performance threshold at exactly 3 and at 4 hits, and carry functions,
classes and imports for the element extractors.  No line is shared by two
consecutive snippets, so the diff of ``(k, k+1)`` is the whole snippet pair.

Columns: snip_id, language, code, hint_from, hint_to (a mapping hint for the
pair whose legacy side is this snippet, or None).
"""

from __future__ import annotations

SNIPPETS = [
    # 0 java
    ("java", """package com.acme.legacy;
import java.util.List;
import java.security.MessageDigest;
public class UserDao {
    private String password = "hunter2";
    public List<String> loadUser(int id, String name) {
        MessageDigest md = MessageDigest.getInstance("MD5");
        return executeQuery("SELECT a+b FROM users WHERE id=?");
    }
    public int countRows(String table) {
        return jdbc.query("select count(*) from users");
    }
    public int countRows(String table, int limit) {
        return 0;
    }
}""", "loadUser", "fetchUser"),
    # 1 java
    ("java", """package com.acme.users;
import org.springframework.web.bind.annotation.RestController;
import org.springframework.stereotype.Service;
import org.slf4j.Logger;
@RestController
public class UserController {
  private static final Logger logger = LoggerFactory.getLogger(UserController.class);
  private String api_key = 'abc123';
  public User fetchUser(int id, String name) {
    try {
      return service.find(id);
    } catch (Exception e) {
      logger.error("lookup failed, retry with fallback", e);
      return null;
    }
  }
  public int countRow(String table) { return 1; }
  // proprietary module
}""", "countRows", "missingName"),
    # 2 java
    ("java", """package com.acme.events;
import org.apache.kafka.clients.producer.KafkaProducer;
import com.rabbitmq.client.Channel;
public class OrderEvents {
    @Repository
    private EventBus eventbus;
    public void publish(String topic, String body) {
        pubsub.send(topic, body);
        Statement.execute("insert into log values ('+')");
        log4j.info("messaging with hibernate and jpa and mybatis");
    }
    public void publishAll(String topic) {
        MessageDigest.getInstance("SHA1");
    }
}""", "publish", "handleOrder"),
    # 3 java
    ("java", """package com.acme.cloud;
import com.amazonaws.services.s3.AmazonS3;
import com.amazonaws.services.dynamodbv2.AmazonDynamoDB;
public class CloudStore {
    // uses aws-sdk: s3, dynamodb, lambda, ec2, rds, sns and sqs
    String aws_access_key; String aws-secret-key;
    @Dao
    public void handleOrder(String datalayer, int n) {
        testng.run();
    }
    public void handleOrders(String datalayer, int n) {
    }
    // Licensed under GPLv3 (gnu_general_public_license)
}""", None, None),
    # 4 java
    ("java", """package com.acme.azure;
import com.azure.storage.blob.BlobClient;
public class AzureSync {
    // azure blob storage, cosmosdb, functions
    // google-cloud gcs and firestore with cloud-functions
    public void syncAll(String bucket) {
        monitoring.tracing(metrics);
    }
    public void syncOne(String bucket, int id) {
    }
    // commercial_license; agpl-v3
}""", "syncAll", "startServer"),
    # 5 javascript
    ("javascript", """import express from 'express';
import { format } from "util";
const winston = require('winston');
const bunyan = require("bunyan");
function startServer(port, host) {
  const app = express();
  document.write("<p>" + host + "</p>");
  el.innerHTML = userInput
  var d = new Date(2020, 1, 1);
  handler.call(null, d);
  var f = arguments.callee;
  with (app) { listen(port); }
  return eval("port + 1");
}
function legacyIE(evt) {
  if (document.all) { evt = window.event; }
  el.attachEvent('onclick', evt); el.detachEvent('onclick', evt);
  document.createStyleSheet('a.css');
}""", "startServer", "startApp"),
    # 6 javascript
    ("javascript", """import fastify from 'fastify';
const crypto = require('crypto');
function startApp(port, host) {
  const h1 = crypto.createHash('md5');
  const h2 = crypto.createHash("sha1");
  setTimeout(run, 0);
  const g = Function("return 1");
  console.log(process.version, node_version, v8-version);
  var secret = "s3cr3t-value";
  var token = 'tok-123';
  var github_token;
}
describe('server', () => {
  it('starts', () => { jest.fn(); sinon.stub(); });
  test('mocha compat', () => {});
});""", "startApp", "startApp"),
    # 7 javascript
    ("javascript", """function renderRows(rows) {
  for (var i = 0; i < .length; i++) {}
  for (var j = 0; j < .length; j++) {}
  for (var k = 0; k < .length; k++) {}
  for (var m = 0; m < .length; m++) {}
  document.getElementById('a'); document.getElementById('b');
  document.getElementById('c'); document.getElementById('d');
  new RegExp('x'); new RegExp('y'); new RegExp('z');
}
function configure(firstArgumentName, secondArgumentName, thirdArgument) {
  // TODO tidy this up
  // FIXME handle nulls
  //HACK for the old browser
  fs.readFile('../../etc/passwd');
  fetch('/static/..%2f..%2fsecret');
}
const block = { alpha: 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa', beta: 'bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb', gamma: 'cccccccccccccccccccccccccccccccccccccccccccccccccccccccccccc', delta: 'dddd' };""",
     "renderRows", "renderTable"),
    # 8 javascript
    ("javascript", """import { Sequelize } from 'sequelize';
import { DataSource } from "typeorm";
const mongoose = require('mongoose');
function renderTable(rows) {
  new RegExp('a'); new RegExp('b'); new RegExp('c'); new RegExp('d'); new RegExp('e');
  document.getElementById('x'); document.getElementById('y'); document.getElementById('z');
  db.query("select 1+1");
}
function migrate(prisma) {
  // migration of the schema with terraform, pulumi, cdk, serverless and cloudformation
}""", None, None),
    # 9 javascript
    ("javascript", """import yaml from 'js-yaml';
const flags = require('node-gpl-flags');
function deploy(cluster) {
  // dockerfile and docker-compose for kubernetes (k8s) via helm, one container each
  var private_key = "-----BEGIN KEY-----";
  var access_key = 'AKIA0000';
  var database_password;
  copy('..\\..\\windows');
  copy('..%5c..%5cwin');
}
// copyleft and copyleft-left terms, closed-source parts
function deployAll(clusters) {
}""", "deploy", "deployAll"),
    # 10 python
    ("python", """import os
import hashlib
from flask import Flask
from django.db import models
def load_rows(path, limit):
    data = open("../../etc/hosts").read()
    cursor.execute("select a+b from t")
    return md5(data), sha1(data), des(data), rc4(data)
def load_all(path):
    return pytest.main(), unittest.main()""", "load_rows", "read_rows"),
    # 11 python
    ("python", """import logging
from sqlalchemy import create_engine
def read_rows(path, limit):
    try:
        return engine.execute(path)
    except Exception as exc:
        logging.exception(exc)
        return retry(fallback)
def read_one(path):
    return eval(path)
# gnu-affero-general-public-license""", "read_one", "read_first"),
    # 12 python
    ("python", """import json
import copyleft_tools
from typing import List
class Loader:
    def parse(self, text, strict):
        return json.loads(text)
    def parse(self, text):
        return text
def read_first(path, mode):
    return path""", "parse", "parse_text"),
    # 13 python
    ("python", """import csv
from collections import OrderedDict
def parse_text(self, text, strict):
    return csv.reader(text)
def parsed(rows):
    return OrderedDict(rows)
def parses(rows):
    return rows""", None, None),
    # 14 python
    ("python", """import re
def tokenize(text, pattern):
    return re.findall(pattern, text)
def tokenise(text, pattern):
    return text.split()""", "tokenize", "main"),
    # 15 c
    ("c", """#include <stdio.h>
#include "util.h"
int main(int argc, char **argv) {
    printf("%d", argc);
    return 0;
}
static int helper(int x) {
    return x * 2;
}""", "main(int argc, char **argv)", "main(int argc, char *argv[])"),
    # 16 c
    ("c", """#include <stdlib.h>
#include "buffer.h"
int main(int argc, char *argv[]) {
    char *buf = malloc(64);
    free(buf);
    return 1;
}
void reset(char *buf, int n) {
    buf[0] = 0;
}""", None, None),
    # 17 c
    ("c", """#include <string.h>
size_t measure(const char *s) {
    return strlen(s);
}
int compare(const char *a, const char *b) {
    return strcmp(a, b);
}""", None, None),
    # 18 c
    ("c", """#include <math.h>
#include "vec.h"
double norm(double x, double y) {
    return sqrt(x * x + y * y);
}""", None, None),
    # 19 c
    ("c", """#include <time.h>
long stamp(void) {
    return (long) time(NULL);
}""", None, None),
    # 20 cpp
    ("cpp", """#include <vector>
#include "graph.hpp"
int sum(std::vector<int> v) {
    int s = 0; for (int x : v) s += x;
    return s;
}""", None, None),
    # 21 cpp
    ("cpp", """#include <string>
#include <iostream>
int sum(const std::vector<int> &v) {
    return std::accumulate(v.begin(), v.end(), 0);
}
void greet(std::string who) {
    std::cout << who;
}""", None, None),
    # 22 cpp
    ("cpp", """#include <map>
int lookup(std::map<int, int> m, int k) {
    return m[k];
}""", None, None),
    # 23 cpp
    ("cpp", """#include <memory>
#include "node.hpp"
void link(Node *a, Node *b) {
    a->next = b;
}""", None, None),
]


def _tag_closers(code: str, snip_id: int) -> str:
    """Give every bare closing-brace line a comment naming its snippet.

    Keeps neighbouring snippets from sharing a line such as ``}``.
    """
    out = []
    for n, line in enumerate(code.split("\n")):
        if line.strip() in ("}", "};", "});"):
            line = f"{line} // end{snip_id}.{n}"
        out.append(line)
    return "\n".join(out)


def snippet_rows():
    """Rows (snip_id, language, code, hint_from, hint_to)."""
    return [(i, lang, _tag_closers(code, i), hf, ht)
            for i, (lang, code, hf, ht) in enumerate(SNIPPETS)]


N_SNIPPETS = len(SNIPPETS)
